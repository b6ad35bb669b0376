"""Schemas and key lists.

All tables have fixed, explicit schemas; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
    VariantType,
)

# The six text columns of an attack record, in stored order.
TEXT_COLUMNS = [
    "source_ip",
    "destination_ip",
    "username",
    "password",
    "attack_type",
    "evidence",
]

# Uniqueness key of a stored attack: time plus the six text columns.
KEY7 = ["timestamp", *TEXT_COLUMNS]

# --- fixed values (must equal the reference's for equal results) ---------
# Separator used when counting distinct username/password logins.
LOGIN_SEPARATOR = " <-| username @ password |-> "
# Epoch milliseconds of the zero time (0001-01-01T00:00:00Z), stored for
# submissions whose attack_timestamp is absent or null.
ZERO_TIME_MS = -62135596800000
# Only POST requests to this path carry a submission.
SUBMIT_METHOD = "POST"
SUBMIT_PATH = "/add_attack"
# ---------------------------------------------------------------------------

# Wire record: one JSON object per request body.
SUBMISSION = StructType(
    [
        StructField("source_ip", StringType()),
        StructField("destination_ip", StringType()),
        StructField("username", StringType()),
        StructField("password", StringType()),
        StructField("attack_timestamp", StringType()),
        StructField("evidence", StringType()),
        StructField("attack_type", StringType()),
        StructField("test_mode", BooleanType()),
    ]
)

# Decoding schema: every field as VARIANT so one JSON parse yields both the
# value and its JSON type (a number in a text field must reject the record).
SUBMISSION_VARIANT = StructType(
    [StructField(f.name, VariantType()) for f in SUBMISSION.fields]
    + [StructField("_corrupt_record", StringType())]
)

# Flat table of the first storage generation; all but id nullable.
LEGACY = StructType(
    [
        StructField("id", LongType(), False),
        StructField("source_ip", StringType()),
        StructField("destination_ip", StringType()),
        StructField("username", StringType()),
        StructField("password", StringType()),
        StructField("attack_timestamp", LongType()),
        StructField("evidence", StringType()),
        StructField("attack_type", StringType()),
    ]
)

# One dictionary table per text column.
DICT = StructType(
    [
        StructField("id", LongType(), False),
        StructField("value", StringType(), False),
    ]
)

# Coded fact table: the six text columns hold dictionary ids.
FACT = StructType(
    [StructField("id", LongType(), False), StructField("timestamp", LongType(), False)]
    + [StructField(c, LongType(), False) for c in TEXT_COLUMNS]
)

# Decoded attacks: the input of every view and report.
ATTACKS = StructType(
    [StructField("id", LongType()), StructField("timestamp", LongType())]
    + [StructField(c, StringType()) for c in TEXT_COLUMNS]
)

# Dictionary table names, per text column.
DICT_NAMES = {
    "source_ip": "source_ips",
    "destination_ip": "destination_ips",
    "username": "usernames",
    "password": "passwords",
    "attack_type": "attack_types",
    "evidence": "evidences",
}
