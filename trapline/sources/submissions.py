"""Raw submissions: read, decode, quarantine, clean.

A submission is one JSON object per request body. Decoding follows the
strict rules of the original wire format:

  * unknown keys are ignored; a key given twice keeps its last value;
  * absent or JSON-null text fields become ''; an absent/null flag is false;
  * a value of the wrong JSON type (number in a text field, text in the flag)
    rejects the whole record; so does broken JSON, a non-object body, or text
    after the closing brace; the literal body ``null`` is an all-default record;
  * the time must match one of two layouts (``functions.timefn``); absent,
    null or the text "null" give the zero time.

Keys match ignoring letter case; when a key repeats (in any casing), the
last non-null value wins, and every occurrence must have the right type.

One JSON parse per row: ``from_json`` into a map of VARIANT values keeps all
keys in input order with their JSON types, so the type gate and the case
folding need no second parse.
Rejected rows keep their body and a reason and go to their own sink; a bad
record never stops the flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text, timefn
from ..operators import filters
from ..schema import SUBMISSION, SUBMISSION_VARIANT, ZERO_TIME_MS

# raw request as a proxy logs it; extra columns pass through decode untouched
REQUEST = StructType(
    [
        StructField("method", StringType()),
        StructField("path", StringType()),
        StructField("body", StringType()),
    ]
)

# fixed values: JSON insignificant white space (blank, tab, LF, CR)
JSON_BLANKS = " \t\n\r"

# rejection reasons
NOT_JSON_OBJECT = "not_json_object"
WRONG_TYPE = "wrong_field_type"
BAD_TIME = "bad_attack_timestamp"

_TEXT_FIELDS = ["source_ip", "destination_ip", "username", "password", "evidence", "attack_type"]


def read_submissions(spark: SparkSession, path: str, fmt: str = "text", streaming: bool = False,
                     **options) -> DataFrame:
    """Read raw bodies. ``fmt='text'``: one body per line (column ``body``);
    ``fmt='parquet'``: a request table with at least a ``body`` column
    (``method``/``path`` when logged). Works for batch and streaming."""
    reader = spark.readStream if streaming else spark.read
    if fmt == "text":
        df = reader.options(**options).text(path)
        return df.withColumnRenamed("value", "body")
    schema = options.pop("schema", REQUEST)
    return reader.schema(schema).options(**options).format(fmt).load(path)


def _type_ok(v: F.Column, allowed: tuple[str, ...]) -> F.Column:
    return v.isNull() | F.schema_of_variant(v).isin(*allowed, "VOID")


def _text_of(v: F.Column) -> F.Column:
    return F.variant_get(v, "$", "string")


def _is_null_time(v: F.Column) -> F.Column:
    """JSON null or the text "null": the time decoder leaves the value as is."""
    return v.isNull() | F.is_variant_null(v) | (_text_of(v) == F.lit("null"))


def _parse_exact(df: DataFrame, body: F.Column, tz, name: str = "_pe"):
    """One struct parse; keys must match in letter case; a repeated key
    keeps its last value. Gives what ``_parse_map`` gives."""
    j = F.from_json(
        body,
        SUBMISSION_VARIANT,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    # The parse sits behind a generator (one element per row, NULL kept):
    # filters on fields of the parse are then not rewritten below it, which
    # would inline one full JSON parse per field reference.
    df = df.withColumn(name, F.explode(F.array(j)))
    p = F.col(name)
    parsed = p.isNotNull() & p["_corrupt_record"].isNull()
    return (*_read_once(df, _fields({f.name: p[f.name] for f in SUBMISSION.fields}), tz), parsed)


_FIELD_NAMES = [f.name for f in SUBMISSION.fields]


def _field_struct(types_ok: F.Column, values: dict[str, F.Column], times: F.Column) -> F.Column:
    """What a reading takes of an object: ``times`` are the texts of its times other than
    null, in order; of a field of the wrong type only ``types_ok`` counts."""
    texts = [_text_of(values[n]).alias(n) for n in _TEXT_FIELDS]
    flag = F.try_variant_get(values["test_mode"], "$", "boolean")
    return F.struct(types_ok.alias("types_ok"), *texts, flag.alias("test_mode"), times.alias("times"))


def _fields(jf: dict[str, F.Column]) -> F.Column:
    """Fields of a parsed object whose field keys are exact and unique."""
    types_ok = F.lit(True)
    for name in _TEXT_FIELDS + ["attack_timestamp"]:
        types_ok = types_ok & _type_ok(jf[name], ("STRING",))
    types_ok = types_ok & _type_ok(jf["test_mode"], ("BOOLEAN",))
    times = F.filter(F.array(_text_of(jf["attack_timestamp"])), lambda t: t != F.lit("null"))
    return _field_struct(types_ok, jf, times)


def _fields_folded(m: F.Column) -> F.Column:
    """Fields of a parsed object read like the original decoder: a field
    takes the last non-null value among keys equal to its name ignoring
    letter case; every occurrence must have the right JSON type and every
    non-null time must parse (it reads them in turn)."""
    kv = F.transform(
        F.map_entries(m), lambda e: F.struct(F.lower(F.upper(e["key"])).alias("k"), e["value"].alias("v"))
    )

    def occurrences(name):
        return F.filter(kv, lambda e: e["k"] == F.lit(name))

    def last(arr):
        return F.try_element_at(arr, F.lit(-1))["v"]

    def all_typed(name, allowed):
        return F.forall(occurrences(name), lambda e: F.schema_of_variant(e["v"]).isin(*allowed, "VOID"))

    jf = {}
    for name in _TEXT_FIELDS + ["test_mode"]:
        jf[name] = last(F.filter(occurrences(name), lambda e: ~F.is_variant_null(e["v"])))
    types_ok = F.lit(True)
    for name in _TEXT_FIELDS + ["attack_timestamp"]:
        types_ok = types_ok & all_typed(name, ("STRING",))
    types_ok = types_ok & all_typed("test_mode", ("BOOLEAN",))
    times = F.filter(occurrences("attack_timestamp"), lambda e: ~_is_null_time(e["v"]))
    return _field_struct(types_ok, jf, F.transform(times, lambda e: _text_of(e["v"])))


def _read_once(df: DataFrame, fields: F.Column, tz):
    """``df`` with the fields and their times, each worked out once for a row -> the frame,
    whether types and times are right, the time, and the fields.

    As the parse they sit behind generators; a reference to a field would otherwise
    repeat its reading wherever it stands, in filters pushed below as well."""
    df = df.withColumn("_fields", F.explode(F.array(fields)))
    parsed_times = F.transform(F.col("_fields.times"), lambda t: timefn.parse_flexible_time(t, tz))
    df = df.withColumn("_times", F.explode(F.array(parsed_times)))
    f, ms = F.col("_fields"), F.col("_times")
    millis = F.when(F.size(ms) == 0, F.lit(ZERO_TIME_MS)).otherwise(F.try_element_at(ms, F.lit(-1)))
    return df, f["types_ok"], F.forall(ms, lambda t: t.isNotNull()), millis, {n: f[n] for n in [*_TEXT_FIELDS, "test_mode"]}


def _parse_map(df: DataFrame, body: F.Column, tz, name: str = "_pm"):
    """One parse into a map of VARIANT values (all keys kept, in input
    order, repeats included). Rows whose field keys are exact and unique
    (nearly all) read fields by lookup; the others take the folded reading."""
    # The parser stops at the end of the first value, so the body is parsed as
    # the first of two: text after its closing brace breaks the array or gives
    # it another length. The second's key is the body's own digest, which no
    # body can hold, so none can close the array itself.
    mark = F.md5(body)
    both = F.from_json(
        F.concat(F.lit("["), body, F.lit(',{"'), mark, F.lit('":true}]')), "array<map<string,variant>>", {"mode": "PERMISSIVE"}
    )
    df = df.withColumn("_both", F.explode(F.array(both))).withColumn("_mark", mark)  # parse once, see _parse_exact
    whole = (F.size("_both") == 2) & F.coalesce(F.map_contains_key(F.get("_both", F.lit(1)), F.col("_mark")), F.lit(False))
    df = df.withColumn(name, F.when(whole, F.get("_both", F.lit(0))))
    mc = F.col(name)
    names = F.array(*[F.lit(n) for n in _FIELD_NAMES])
    keys = F.map_keys(mc)
    # keys folded in one string operation (no per-key lambda): a repeated key
    # (in any casing) or a field key only present in another casing sends the
    # row to the folded reading; other repeats are harmless false positives.
    # Nothing is folded where all keys are field names as they are, none twice
    plain = (F.size(F.array_except(keys, names)) == 0) & (F.size(F.array_distinct(keys)) == F.size(keys))
    sep = "\u0001"
    folded_keys = F.when(~plain, F.split(F.lower(F.upper(F.array_join(keys, sep))), sep))
    df = df.withColumn(
        "_fold",
        F.coalesce(
            ~plain
            & (
                (F.size(F.array_distinct(folded_keys)) != F.size(folded_keys))
                | (F.size(F.array_intersect(folded_keys, names)) != F.size(F.array_intersect(keys, names)))
            ),
            F.lit(False),
        ),
    )
    direct = _fields({n: mc[n] for n in _FIELD_NAMES})
    fields = F.when(F.col("_fold"), _fields_folded(mc)).otherwise(direct)
    return (*_read_once(df, fields, tz), mc.isNotNull())


def decode_tagged(requests: DataFrame, body_col: str = "body", tz: str | None = None,
                  key_case: str = "fold") -> DataFrame:
    """Decode bodies into one frame: the other input columns, the body, the
    decoded fields and ``reason`` (NULL when accepted). ``split`` turns it
    into ``(accepted, rejected)``; persisting it first parses each body once
    for both outputs.

    ``key_case='fold'`` (default) matches keys ignoring letter case, like the
    original decoder; ``'exact'`` needs exact key names.
    """
    passthrough = [c for c in requests.columns if c != body_col]
    body = F.col(body_col)
    df = requests.select(*passthrough, body.alias(body_col), F.btrim(body, F.lit(JSON_BLANKS)).alias("_s"))
    parse = _parse_map if key_case == "fold" else _parse_exact
    df, types_ok, times_ok, millis, fields, parsed = parse(df, body, tz)

    null_body = F.col("_s") == F.lit("null")
    is_object = parsed & F.col("_s").startswith("{") & F.col("_s").endswith("}")
    reason = (
        F.when(null_body, F.lit(None).cast("string"))
        .when(~is_object, F.lit(NOT_JSON_OBJECT))
        .when(~types_ok, F.lit(WRONG_TYPE))
        .when(~times_ok | millis.isNull(), F.lit(BAD_TIME))
    )

    def text_value(name):
        return F.when(null_body, F.lit("")).otherwise(F.coalesce(fields[name], F.lit("")))

    return df.select(
        *passthrough,
        F.col(body_col),
        *[text_value(c).alias(c) for c in ["source_ip", "destination_ip", "username", "password"]],
        F.when(null_body, F.lit(ZERO_TIME_MS)).otherwise(millis).alias("timestamp"),
        *[text_value(c).alias(c) for c in ["evidence", "attack_type"]],
        F.when(null_body, F.lit(False)).otherwise(F.coalesce(fields["test_mode"], F.lit(False))).alias("test_mode"),
        reason.alias("reason"),
    )


_DECODED = ["source_ip", "destination_ip", "username", "password", "timestamp", "evidence", "attack_type", "test_mode"]


def split(tagged: DataFrame, body_col: str = "body"):
    """``decode_tagged`` output -> ``(accepted, rejected)``."""
    passthrough = [c for c in tagged.columns if c not in (*_DECODED, body_col, "reason")]
    accepted = tagged.filter(F.col("reason").isNull()).select(*passthrough, *_DECODED)
    rejected = tagged.filter(F.col("reason").isNotNull()).select(*passthrough, body_col, "reason")
    return accepted, rejected


def decode(requests: DataFrame, body_col: str = "body", tz: str | None = None, key_case: str = "fold"):
    """Decode bodies -> ``(accepted, rejected)``.

    accepted: the other input columns + source_ip, destination_ip, username,
    password, timestamp (epoch ms), evidence (as sent), attack_type, test_mode.
    rejected: the other input columns + body + reason.
    """
    return split(decode_tagged(requests, body_col, tz, key_case), body_col)


def clean(accepted: DataFrame) -> DataFrame:
    """Drop test records and trim Unicode white space off the evidence."""
    out = filters.drop_test(accepted).withColumn("evidence", text.trim_unicode("evidence"))
    return out.drop("test_mode")


def ingest_requests(requests: DataFrame, tz: str | None = None):
    """Route, decode and clean raw requests -> ``(records, rejected)``.

    records carry the other request columns plus timestamp and the six text
    columns, ready for dedup and storage."""
    routed = filters.only_submissions(requests).drop("method", "path")
    accepted, rejected = decode(routed, tz=tz)
    return clean(accepted), rejected


__all__ = [
    "REQUEST",
    "read_submissions",
    "decode",
    "decode_tagged",
    "split",
    "clean",
    "ingest_requests",
]
