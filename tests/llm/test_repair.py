import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from llm_cases import CLASHES, SF

from trapline.llm import oracle, queries, repair
from trapline.llm.shipping import prepare

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"
WORD, ROLES = r"[^\x20\x09-\x0D]", re.compile(r"(s?(ua)+)?\Z")


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def slow_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.findall(WORD, text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(rows, faults):
    """Every sequence of row edits: (cost, audit, roles, lines), with up to two inserts before each row and at the end."""
    inserts = [list(itertools.product(("user", "assistant"), repeat=n)) for n in range(3)]
    places = [[x for n in inserts for x in n] for _ in range(len(rows) + 1)]
    edits = []
    for (_, _, role, text), fault in zip(rows, faults):
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            late = 5 * (fault == "truncated")
            own += [("K", late, (role, text)), ("R", 1 + late, ("user", text)), ("R", 1 + late, ("assistant", text))]
        edits.append(own)
    for way in itertools.product(*edits):
        for put in itertools.product(*places):
            if sum(map(len, put)) > 3:
                continue
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                cost += 5 * len(put[k])
                audit += "I" * len(put[k])
                lines += [(r, "") for r in put[k]]
                if k < len(rows):
                    e, c, line = way[k]
                    cost, audit = cost + c, audit + e
                    lines += [line] if line else []
            initials = [r[:1] for r, _ in lines]
            if all(initials) and ROLES.match("".join(initials)):
                yield cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)


def slow_best(rows, faults):
    """The least (cost, audit) by plain strings, layer by layer."""
    start = {"": (0, "", ())}

    def offer(layer, shape, new):
        if shape not in layer or new < layer[shape]:
            layer[shape] = new

    def step(shape, initial):  # shapes: "", s, u, a
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[shape].get(initial)

    def grown(layer):
        for _ in range(3):
            for shape, (cost, audit, lines) in list(layer.items()):
                for role in ("user", "assistant"):
                    if (to := step(shape, role[0])) is not None:
                        offer(layer, to, (cost + 5, audit + "I", (*lines, f"{role}:")))
        return layer

    layer = grown(start)
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for shape, (cost, audit, lines) in layer.items():
            offer(after, shape, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 * (fault == "truncated")
            for edit, more, who in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                if (to := step(shape, who[:1])) is not None:
                    offer(after, to, (cost + more + late, audit + edit, (*lines, f"{who}:{text}")))
        layer = grown(after)
    cost, audit, lines = min(layer[s] for s in ("", "a") if s in layer)
    return cost, audit, "\n".join(lines)


def slow(rows):
    after = slow_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, turns = slow_faults(own), [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = slow_best(own, faults)
        yield conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def run_query(spark, rows, tmp_path, parts=1, extra=()):
    prepare(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", *[f"'own' AS {c}" for c in extra])
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == COLUMNS
    return got.collect()


def mixed(seed, convs=60, longest=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Yes.", "Why?\t", "ok!", "long. tail"]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ubuntu", "", None])
            rows.append((None if c == 3 else c, rng.choice([t, t, t, t + 1, None]), role, rng.choice([None, *texts, f"t{rng.randrange(9)}."])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_least_edits_against_every_edit(seed):
    rng = random.Random(seed)
    for _ in range(12):
        rows = [(0, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", "", "d!"])) for t in range(rng.randrange(0, 4))]
        faults = slow_faults(rows)
        code = {"": repair.SOUND, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.CUT}
        cost, audit = repair._best_end(repair.piece_ways([r[2][:1] for r in rows], [code[f] for f in faults], (repair.START,))[repair.START])
        wanted = min(options(rows, faults))
        assert (cost, audit) == wanted[:2]
        assert "\n".join(repair.repaired(audit, repair.START, ((r[2], r[2][:1], r[3]) for r in rows))) == wanted[2]
        assert slow_best(rows, faults) == wanted


def test_chunks_and_pieces_agree(monkeypatch):
    rng = random.Random(5)
    for n in (0, 1, 5, 40, 200):
        initials = [rng.choice("uuaasx") for _ in range(n)]
        faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        whole = repair.piece_ways(initials, faults, (0, 1, 2, 3))
        monkeypatch.setattr(repair, "CHUNK", 7)
        assert repair.piece_ways(initials, faults, (0, 1, 2, 3)) == whole
        monkeypatch.undo()


@pytest.mark.parametrize("modulus", [repair._MODULUS, 5, 1])
def test_audits_compare_as_strings(monkeypatch, modulus):
    """Also where most hashes collide."""
    monkeypatch.setattr(repair, "_MODULUS", modulus)
    rng, audits = random.Random(7), repair.Audits()
    nodes = [0]
    for _ in range(300):
        nodes.append(audits.add(rng.choice(nodes[-20:]), rng.choice("DIKR")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert audits.less(a, b) == (audits.spelled(a) < audits.spelled(b))
    deep = nodes[-1]
    for k in range(audits.depth[deep] + 1):
        assert audits.spelled(audits.above(deep, k)) == audits.spelled(deep)[: audits.depth[deep] - k]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, tmp_path, seed):
    """Nulls in every column, empty texts, ties, repeated rows, clashing columns."""
    rows = mixed(seed)
    rows += rows[:5]
    wanted = sorted_rows(slow(rows))
    assert sorted_rows(run_query(spark, rows, tmp_path, 3, CLASHES)) == wanted
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(oracle.OP11_SQL)
    assert [c[0] for c in found.description] == COLUMNS
    assert sorted_rows(found.fetchall()) == wanted


def test_conversation_over_many_partitions(spark, tmp_path):
    """One conversation holds most rows, many of them equal or without a turn."""
    rng = random.Random(11)
    rows = [(7, rng.choice([None, t, t // 3]), rng.choice(["user", "assistant", "system"]), rng.choice(["same.", "cut", "", f"x{t % 50}.", f"y{t}!"])) for t in range(1500)]
    rows += [(c, t, "user", "q?") for c in range(5, 10) for t in range(3)] + [(99, t, "assistant", None) for t in range(200)]
    assert sorted_rows(run_query(spark, rows, tmp_path, 4)) == sorted_rows(slow(rows))


def test_no_rows_after_damage_and_no_rows(spark, tmp_path):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = run_query(spark, [(gone, 0, "user", "x.")], tmp_path)
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run_query(spark, [], tmp_path / "none") == []


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted_rows(queries.op11_conversation_repair(spark, SF).collect()) == sorted_rows(slow(rows))
