"""Three small demo feeds: payments, accounts and alerts.

Fixed values: ids, status codes, amounts, dates and change times, which decide
the expected results. Everything else is made up by rule.
"""

import json

from tidemark.config import PipelineConfig
from tidemark.functions import rules as R
from tidemark.schema import ddl, plain_schema

TRANSACTIONS_RAW = ddl(
    "transaction_id varchar(64) not null, account_number varchar(32), tx_date varchar(32), "
    "tx_amount double, currency_code varchar(8), tx_payload string, status varchar(32), "
    "source_system varchar(64), updated_at timestamp_ntz"
)
TRANSACTIONS_CLEAN = ddl(
    "transaction_id varchar(64) not null, customer_id varchar(64), "
    "account_number_hash varchar(128), tx_date date, tx_amount decimal(18,2), "
    "currency_code varchar(8), merchant_name varchar(256), merchant_category varchar(128), "
    "merchant_city varchar(128), merchant_country varchar(8), payment_method varchar(64), "
    "status varchar(32), source_system varchar(64), loaded_at timestamp_ntz"
)
ACCOUNTS_RAW = ddl(
    "account_id varchar(32) not null, customer_id varchar(64), account_type varchar(32), "
    "account_status varchar(4), balance varchar(32), credit_limit varchar(32), "
    "interest_rate varchar(16), risk_score varchar(4), opened_date varchar(32), "
    "last_activity_date varchar(32), branch_code varchar(16), relationship_mgr varchar(128)"
)
ACCOUNTS_CLEAN = ddl(
    "account_id varchar(32) not null, customer_id varchar(32), account_type varchar(32), "
    "account_status varchar(32), balance decimal(18,2), credit_limit decimal(18,2), "
    "interest_rate_pct decimal(8,4), risk_score decimal(4,0), risk_band varchar(16), "
    "opened_date date, last_activity_date date, branch_code varchar(16), loaded_at timestamp_ntz"
)
FLAGS_RAW = ddl(
    "flag_id varchar(64) not null, transaction_id varchar(64) not null, account_id varchar(32), "
    "fraud_score varchar(8), severity_code varchar(4), detection_timestamp_ms decimal(18,0), "
    "rules_triggered varchar(512), analyst_reviewed varchar(8), review_outcome varchar(32), "
    "is_deleted boolean, updated_at timestamp_ntz"
)
FLAGS_CLEAN = ddl(
    "transaction_id varchar(64) not null, account_id varchar(32), fraud_score decimal(5,2), "
    "severity_code decimal(2,0), severity_label varchar(16), detection_timestamp timestamp_ntz, "
    "rules_triggered varchar(512), rule_count decimal(4,0), analyst_reviewed boolean, "
    "review_outcome varchar(32), loaded_at timestamp_ntz"
)

# number, amount, status, change time
_PAYMENTS = [
    (1, 1250.75, "COMPLETED", "2024-01-15 09:23:11"),
    (2, 89.99, "COMPLETED", "2024-01-16 14:05:32"),
    (3, None, "PENDING", "2024-01-17 08:11:00"),
    (4, 4500.0, "COMPLETED", "2024-01-17 16:45:22"),
    (5, 22.5, "COMPLETED", "2024-01-18 11:30:00"),
    (6, 999.0, "TEST", "2024-01-18 00:00:01"),
    (7, 3200.0, "COMPLETED", "2024-01-19 20:14:55"),
    (8, 150.0, "CANCELLED", "2024-01-20 09:00:00"),
    (9, 78.4, "COMPLETED", "2024-01-20 15:08:33"),
    (10, 12500.0, "COMPLETED", "2024-01-21 10:00:00"),
    (11, 45.0, "COMPLETED", "2024-01-22 06:00:00"),
    (12, 8900.5, "COMPLETED", "2024-01-22 14:33:21"),
    (13, 299.99, "PENDING", "2024-01-23 17:45:00"),
    (14, 55.2, "COMPLETED", "2024-01-24 07:15:44"),
    (15, 2100.0, "COMPLETED", "2024-01-25 11:30:00"),
]

# status code, balance, credit limit, rate, risk score, opened
_ACCOUNTS = [
    ("A", "12,450.75", None, "0.50%", "2", "15-JAN-2020"),
    ("A", "87,320.00", None, "2.75%", "1", "03-MAR-2018"),
    ("A", "245,800.50", None, "5.20%", "3", "22-JUL-2015"),
    ("A", "3,200.00", None, "0.50%", "4", "10-SEP-2021"),
    ("A", "1,250,000.00", None, "6.10%", "1", "01-JAN-2010"),
    ("S", "0.00", None, "0.50%", "8", "14-FEB-2022"),
    ("A", "-4,200.00", "10,000.00", "19.99%", "5", "30-NOV-2019"),
    ("D", "125.00", None, "2.75%", "6", "05-AUG-2017"),
    ("A", "-890.50", "5,000.00", "24.99%", "7", "17-APR-2023"),
    ("C", "0.00", None, "0.00%", "9", "28-JUN-2016"),
    ("A", "45,670.25", None, "2.75%", "2", "12-DEC-2020"),
    ("A", "789,100.00", None, "5.80%", "1", "09-OCT-2012"),
]

# flag, payment, score, severity, epoch ms, number of rules, reviewed, outcome, deleted, change time
_FLAGS = [
    (1, 10, "87", "3", 1706094000000, 2, "TRUE", "CONFIRMED", False, "2024-01-24 12:00:00"),
    (2, 12, "95", "4", 1706180400000, 3, "TRUE", "CONFIRMED", False, "2024-01-25 14:00:00"),
    (3, 4, "45", "2", 1705521600000, 1, "FALSE", "PENDING", False, "2024-01-17 17:00:00"),
    (4, 7, "72", "3", 1705694400000, 2, "TRUE", "FALSE_POSITIVE", False, "2024-01-20 09:00:00"),
    (5, 15, "91", "4", 1706180400000, 2, "FALSE", "PENDING", False, "2024-01-25 12:00:00"),
    (3, 4, "45", "2", 1705521600000, 1, "TRUE", "FALSE_POSITIVE", False, "2024-01-21 10:00:00"),
    (4, 7, "72", "3", 1705694400000, 2, "TRUE", "FALSE_POSITIVE", True, "2024-01-22 08:00:00"),
    (6, 13, "33", "1", 1706180400000, 1, "FALSE", "PENDING", False, "2024-01-23 18:00:00"),
    (7, 5, "61", "3", 1705521600000, 2, "TRUE", "CONFIRMED", False, "2024-01-19 09:00:00"),
    (8, 2, "22", "1", 1705435200000, 1, "TRUE", "FALSE_POSITIVE", False, "2024-01-17 10:00:00"),
]


def _frame(spark, rows, schema):
    """Timestamps are given as text and cast."""
    plain = plain_schema(schema)
    text = ", ".join(
        f"{f.name} {'string' if 'timestamp' in f.dataType.simpleString() or 'decimal' in f.dataType.simpleString() else f.dataType.simpleString()}"
        for f in plain.fields
    )
    df = spark.createDataFrame(rows, text)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in plain.fields])


def transactions_raw(spark):
    rows = []
    for n, amount, status, at in _PAYMENTS:
        payload = {
            "merchant_name": f"Shop {n}", "merchant_category": f"KIND_{n % 4}",
            "merchant_city": f"City {n % 6}", "merchant_country": "US",
            "payment_method": "CARD" if n % 2 else "WIRE",
        }
        date = at[:10] if n % 2 else f"{at[5:7]}/{at[8:10]}/{at[:4]}"
        rows.append((f"TXN-{n:03d}", f"ACC-{n:04d}", date, amount, "USD", json.dumps(payload),
                     status, "FEED", at))
    return _frame(spark, rows, TRANSACTIONS_RAW)


def accounts_raw(spark):
    rows = [
        (f"ACC-{i:04d}", f"CUST-{i:04d}", "CHECKING", code, balance, limit, rate, risk, opened,
         "25-JAN-2024", f"BR-{i:03d}", f"Manager {i}")
        for i, (code, balance, limit, rate, risk, opened) in enumerate(_ACCOUNTS, start=1)
    ]
    return _frame(spark, rows, ACCOUNTS_RAW)


def flags_raw(spark):
    rows = [
        (f"FLAG-{f:03d}", f"TXN-{t:03d}", f"ACC-{t:04d}", score, sev, str(ms),
         ",".join(f"RULE_{k:03d}" for k in range(n)), reviewed, outcome, gone, at)
        for f, t, score, sev, ms, n, reviewed, outcome, gone, at in _FLAGS
    ]
    return _frame(spark, rows, FLAGS_RAW)


def transactions_config(source="raw", target="clean", **extra):
    return PipelineConfig(
        pipeline_id="ETL_TRANSACTIONS_001", pipeline_name="transactions_raw_to_clean",
        source_table=source, target_table=target, strategy="INCREMENTAL", domain="finance",
        source_filter="STATUS NOT IN ('TEST', 'CANCELLED')", write_mode="append",
        watermark_col="updated_at", watermark_initial="2024-01-01",
        rules=(
            R.Mask("account_number_hash", "account_number"),
            R.Mask("customer_id", "account_number"),
            R.ToDate("tx_date", formats=("yyyy-MM-dd", "MM/dd/yyyy")),
            R.NumToDecimal("tx_amount"),
            *R.json_fields("tx_payload", {
                c: c for c in ("merchant_name", "merchant_category", "merchant_city",
                               "merchant_country", "payment_method")
            }),
        ),
        error_tolerance_pct=1.0, null_check_cols=("transaction_id",), **extra,
    )


def accounts_config(source="raw", target="clean", **extra):
    return PipelineConfig(
        pipeline_id="ETL_ACCOUNTS_001", pipeline_name="accounts_raw_to_clean",
        source_table=source, target_table=target, strategy="FULL_LOAD", domain="finance",
        write_mode="overwrite",
        rules=(
            R.StrToDecimal("balance", strip=","),
            R.StrToDecimal("credit_limit", strip=","),
            R.StrToDecimal("interest_rate_pct", "interest_rate", 8, 4, strip="%"),
            R.StrToDecimal("risk_score", precision=4, scale=0),
            R.Decode("account_status", labels=(
                ("A", "Active"), ("S", "Suspended"), ("C", "Closed"), ("D", "Dormant"))),
            R.Band("risk_band", "risk_score", (
                (3, "LOW"), (5, "MEDIUM"), (7, "HIGH"), (10, "CRITICAL")), lower=1, cast="int"),
            R.ToDate("opened_date", formats=("dd-MMM-yyyy",)),
            R.ToDate("last_activity_date", formats=("dd-MMM-yyyy",)),
        ),
        error_tolerance_pct=0.5, null_check_cols=("account_id", "customer_id"),
        min_rows_expected=5, **extra,
    )


def flags_config(source="raw", target="clean", **extra):
    return PipelineConfig(
        pipeline_id="ETL_FRAUD_FLAGS_001", pipeline_name="fraud_flags_raw_to_clean",
        source_table=source, target_table=target, strategy="CDC", domain="finance",
        deduplicate=True, dedup_keys=("transaction_id",), dedup_order_by="updated_at DESC",
        write_mode="upsert", merge_keys=("transaction_id",), delete_flag_col="is_deleted",
        rules=(
            R.StrToDecimal("fraud_score", precision=5, scale=2),
            R.StrToDecimal("severity_code", precision=2, scale=0),
            R.Decode("severity_label", "severity_code", (
                ("1", "LOW"), ("2", "MEDIUM"), ("3", "HIGH"), ("4", "CRITICAL"),
                ("5", "BLOCKED"))),
            R.EpochMs("detection_timestamp", "detection_timestamp_ms"),
            R.CsvCount("rule_count", "rules_triggered"),
            R.IsTrue("analyst_reviewed"),
        ),
        error_tolerance_pct=2.0, null_check_cols=("transaction_id",), **extra,
    )
