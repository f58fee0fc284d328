"""Declared tables: key, foreign keys, columns with types, category. Readers use these, never inference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The tables of the relational branch. First column: key. `name>table`: foreign key.
# Types: i integer, n number, t text, c categorical, d date, dt date and time, b boolean.
_SPEC = """
customer_master customer_id:i msisdn:t name:t dob:d email:t address:t circle:t account_type:c activation_date:d kyc_status:c status:c
plan_master plan_id:i plan_name:t price:n validity_days:i data_gb:n voice_minutes:t sms_limit:i ott_benefits:t fiveg_eligible:b auto_renew:b
subscriptions subscription_id:i customer_id>customer_master:i msisdn:t plan_id>plan_master:i activation_date:d expiry_date:d status:c renewal_type:c
recharge_transactions recharge_id:i msisdn:t amount:n plan_id>plan_master:i channel:c timestamp:dt status:c balance_after:n
invoices invoice_id:i customer_id>customer_master:i billing_cycle_start:d billing_cycle_end:d plan_charge:n usage_charge:n vas_charge:n tax_gst:n late_fee:n total_amount:n due_date:d payment_status:c
payment_transactions transaction_id:i invoice_id>invoices:i customer_id>customer_master:i amount:n payment_method:c status:c timestamp:dt gateway_reference:t
sim_inventory sim_id:i iccid:t msisdn:t sim_type:c status:c issue_date:d
esim_profiles profile_id:i customer_id>customer_master:i qr_code:t activation_status:c
network_sites site_id:i latitude:n longitude:n technology:c status:c
network_alarms alarm_id:i site_id>network_sites:i alarm_type:t severity:c raised_at:dt cleared_at:dt root_cause:t
tickets ticket_id:i customer_id>customer_master:i category:c subcategory:c description:t created_at:dt sla_due_at:dt status:c assigned_to:t resolution_notes:t
cdr cdr_id:i msisdn:t call_type:c start_time:dt duration_sec:i destination:t circle:t roaming_flag:b charged_amount:n
roaming_usage roam_id:i customer_id>customer_master:i country:c start_date:d end_date:d voice_minutes:i data_mb:i sms_count:i
kyc_records kyc_id:i customer_id>customer_master:i kyc_type:c status:c last_updated:d
porting_requests port_id:i customer_id>customer_master:i old_circle:c new_circle:c request_date:d status:c
orders order_id:i customer_id>customer_master:i order_type:c order_date:dt status:c amount:n
corporate_accounts corp_id:i company_name:t contact_person:t contact_phone:t segment:c created_at:d
device_config device_id:i brand:c model:c imei:t fiveg_supported:b
device_registry registry_id:i customer_id>customer_master:i device_id>device_config:i registered_at:d
retail_outlets outlet_id:i name:t city:c address:t phone:t
technicians tech_id:i name:t skill:c phone:t
ott_subscriptions ott_id:i customer_id>customer_master:i service_name:c start_date:d end_date:d
offers offer_id:i offer_name:t discount_percent:i valid_from:d valid_to:d
fraud_cases case_id:i customer_id>customer_master:i case_type:c reported_at:dt status:c
vas_subscriptions vas_id:i customer_id>customer_master:i service_name:c start_date:d end_date:d
coverage_5g coverage_id:i region:c coverage_percent:n last_updated:d
fiber_inventory fiber_id:i customer_id>customer_master:i installation_date:d status:c speed_mbps:i
escalation_cases escalation_id:i ticket_id>tickets:i escalated_at:dt level:c status:c
"""


@dataclass(frozen=True)
class Table:
    """A declared table."""

    name: str
    key: str
    kinds: dict[str, str]
    foreign: dict[str, str]

    @property
    def raw(self) -> T.StructType:
        """All columns as text: how files are read, so that long numbers survive."""
        return T.StructType([T.StructField(c, T.StringType(), metadata={"kind": k, "references": self.foreign.get(c, "")}) for c, k in self.kinds.items()])


def _parse(line: str) -> Table:
    name, *columns = line.split()
    kinds, foreign = {}, {}
    for column in columns:
        label, kind = column.split(":")
        label, _, parent = label.partition(">")
        kinds[label] = kind
        if parent:
            foreign[label] = parent
    return Table(name, next(iter(kinds)), kinds, foreign)


TABLES = {t.name: t for t in map(_parse, _SPEC.strip().splitlines())}


def get(name: str) -> Table:
    """The declaration of a table; an unknown name raises ValueError."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return TABLES[name]


COMMON_RESULT = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("retrieval_method", T.StringType()), T.StructField("content", T.StringType()), T.StructField("metadata", T.StringType()),
])

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
DOCUMENT = T.StructType([T.StructField(c, _TEXTS if c in ("related_ids", "tags") else _TEXT) for c in "document_id title document_type category department customer_scope version last_updated source_authority related_ids tags content file_path file_type".split()])
CHUNK = T.StructType([T.StructField("chunk_id", _TEXT), T.StructField("document_id", _TEXT), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", _TEXT), *[f for f in DOCUMENT if f.name not in ("document_id", "content")]])
