"""The SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions.us import STATES
from .inputs import CONTACTS_SQL
from ..sources.csv import NULL_TOKENS
from .queries import CODE, CRLF_TEXT, EMPTY_VALUES, RATIO, REPLACED, REPLACED_BY_COLUMN

ORACLE: dict[str, str] = {}

COLUMNS = [
    "row_id", "name", "phone", "zip", "state", "amount", "signup_date", "status", "mostly_empty", "cust",
]
TEXT = [name for name in COLUMNS if name not in ("row_id", "cust")]
UNNUMBERED = COLUMNS[1:]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]

# RE2 has no Unicode \s; these are the code points that count as whitespace.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"


def remove_control(x: str) -> str:
    return rf"regexp_replace({x}, '[\x00-\x1f\x7f]', '', 'g')"


def remove_punctuation(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]', '', 'g')"


def match_key(x: str) -> str:
    return strip(collapse(remove_punctuation(f"lower({strip(x)})")))


def title(x: str) -> str:
    runs = rf"regexp_extract_all({x}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+')"
    first = "replace(upper(substr(r, 1, 1)), 'ẞ', 'Ss')"
    return f"array_to_string(list_transform({runs}, lambda r: concat({first}, lower(substr(r, 2)))), '')"


def null_if(x: str, values: list[str]) -> str:
    listed = ", ".join(f"'{v}'" for v in ["", *values])
    return f"CASE WHEN {strip(x)} IN ({listed}) THEN NULL ELSE {x} END"


def replaced(x: str, mapping: dict) -> str:
    """One CASE per pair, each over the result of the one before."""
    for old, new in mapping.items():
        x = f"CASE WHEN {x} = '{old}' THEN {'NULL' if new is None else repr(new)} ELSE {x} END"
    return x


def number(x: str, currency: bool = False) -> str:
    x = f"replace({x}, ',', '')"
    if currency:
        cut = rf"regexp_replace({x}, '\A{SPACE}*[$£€]|{SPACE}*[$£€]{SPACE}*\z', '', 'g')"
        x = strip(cut)
    shape = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf(inity)?))\s*$"
    value = f"TRY_CAST(trim({x}) AS DOUBLE)"
    infinite = f"(isinf({value}) AND NOT regexp_matches({x}, '(?i)inf'))"
    return f"CASE WHEN regexp_matches({x}, '{shape}') AND NOT coalesce({infinite}, false) THEN {value} END"


def digits(x: str) -> str:
    return rf"regexp_replace({x}, '\P{{Nd}}', '', 'g')"


def phone_digits(x: str) -> str:
    d = digits(x)
    ten = f"CASE WHEN length({d}) = 11 AND {d} LIKE '1%' THEN substr({d}, 2) ELSE {d} END"
    return f"CASE WHEN length({ten}) = 10 THEN {ten} END"


def phone_us(x: str, country: str = "+1 ") -> str:
    d = phone_digits(x)
    return f"'{country}(' || substr({d}, 1, 3) || ') ' || substr({d}, 4, 3) || '-' || substr({d}, 7)"


def zip_code(x: str, nine: bool = False) -> str:
    d = digits(x)
    long = f"substr({d}, 1, 5)" + (f" || '-' || substr({d}, 6)" if nine else "")
    return f"CASE length({d}) WHEN 5 THEN {d} WHEN 9 THEN {long} END"


def state(x: str, name: bool = False) -> str:
    key = f"replace(lower({strip(x)}), '-', ' ')"
    branches = "".join(
        f" WHEN '{code.lower()}' THEN '{full if name else code}'"
        f" WHEN '{full.lower()}' THEN '{full if name else code}'"
        for code, full in STATES.items()
    )
    return f"CASE {key}{branches} END"


def keep(new: str, old: str) -> str:
    return f"coalesce({new}, {old})"


def pick(columns: list[str], **changed: str) -> str:
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in columns)


def contacts(select: str, *more: str) -> str:
    """A query on contacts; ``more`` are further named subqueries that can build on it."""
    named = ", ".join([f"contacts AS ({CONTACTS_SQL})", *more])
    return f"WITH {named} {select}"


def chain(columns: list[str], source: str, *layers: dict[str, str]) -> str:
    """Subqueries t1, t2, ... that change columns one layer after the other."""
    subqueries, before = [], source
    for i, layer in enumerate(layers, 1):
        subqueries.append(f"t{i} AS (SELECT {pick(columns, **layer)} FROM {before})")
        before = f"t{i}"
    return ", ".join(subqueries)


def each(columns: list[str], change) -> dict[str, str]:
    return {c: change(c) for c in columns}


# -- columns and rows --------------------------------------------------------------------------

ORACLE["drop_columns"] = contacts(
    "SELECT row_id, name, phone, zip, state, amount, signup_date, status FROM contacts"
)
ORACLE["select_columns"] = contacts("SELECT state, row_id, name FROM contacts")
ORACLE["rename_columns"] = contacts(
    "SELECT row_id, name AS phone, phone AS name, zip, state, amount, signup_date, status, "
    "mostly_empty, cust AS customer FROM contacts"
)
ORACLE["drop_empty_columns"] = contacts(
    f"SELECT {pick([c for c in COLUMNS if c != 'mostly_empty'])} FROM contacts"
)
ORACLE["drop_empty_columns_null_only"] = contacts("SELECT * FROM contacts")
_some = " OR ".join(f"{c} IS NOT NULL" for c in UNNUMBERED)
ORACLE["drop_empty"] = contacts(
    f"SELECT * FROM emptied WHERE {_some}",
    "emptied AS (SELECT "
    + pick(UNNUMBERED, **each(UNNUMBERED, lambda c: f"CASE WHEN row_id % 41 <> 0 THEN {c} END"))
    + " FROM contacts)",
)
ORACLE["drop_empty_subset"] = contacts(
    "SELECT * FROM contacts WHERE phone IS NOT NULL OR zip IS NOT NULL OR state IS NOT NULL"
)
ORACLE["drop_missing_any"] = contacts(
    "SELECT * FROM contacts WHERE name IS NOT NULL AND phone IS NOT NULL"
)
ORACLE["drop_missing_all"] = contacts(
    "SELECT * FROM contacts WHERE name IS NOT NULL OR phone IS NOT NULL OR zip IS NOT NULL"
)
ORACLE["dedupe_all"] = contacts(f"SELECT DISTINCT {pick(UNNUMBERED)} FROM contacts")
_key = "PARTITION BY name, state, status"
for _label, _rule in (
    ("first", f"row_number() OVER ({_key} ORDER BY row_id) = 1"),
    ("last", f"row_number() OVER ({_key} ORDER BY row_id DESC) = 1"),
    ("none", f"count(*) OVER ({_key}) = 1"),
):
    ORACLE[f"dedupe_{_label}"] = contacts(f"SELECT * FROM contacts QUALIFY {_rule}")

# -- values ------------------------------------------------------------------------------------


def changed(**columns: str) -> str:
    return contacts(f"SELECT {pick(COLUMNS, **columns)} FROM contacts")


ORACLE["fill_nulls_scalar"] = changed(
    name="coalesce(name, '?')", phone="coalesce(phone, '?')", cust="coalesce(CAST(cust AS STRING), '?')"
)
ORACLE["fill_nulls_per_column"] = changed(
    state="coalesce(state, 'XX')", cust="coalesce(cust, 0)", amount="coalesce(amount, '0')"
)
ORACLE["normalize_empty_strings"] = changed(**each(TEXT, lambda c: null_if(c, EMPTY_VALUES)))
ORACLE["replace_values"] = changed(**each(TEXT, lambda c: replaced(c, REPLACED)))
ORACLE["replace_values_per_column"] = changed(
    **{c: replaced(c, mapping) for c, mapping in REPLACED_BY_COLUMN.items()}
)

# -- text --------------------------------------------------------------------------------------


def documents(**columns: str) -> str:
    return f"SELECT {pick(DOCUMENTS, **columns)} FROM documents"


ORACLE["trim_whitespace"] = changed(**each(TEXT, strip))
ORACLE["case_lower"] = documents(**each(["text", "lang", "source"], lambda c: f"lower({c})"))
ORACLE["case_upper"] = changed(**each(TEXT, lambda c: f"upper({c})"))
ORACLE["case_title"] = documents(text=title("text"))
ORACLE["remove_non_printable"] = documents(text=remove_control("text"))
ORACLE["remove_non_printable_collapse"] = documents(text=strip(collapse(remove_control("text"))))
ORACLE["normalize_for_matching"] = documents(text=match_key("text"))
ORACLE["normalize_for_matching_keep_punct"] = documents(
    text=strip(collapse(f"lower({strip('text')})"))
)
ORACLE["normalize_for_matching_no_collapse"] = changed(
    **each(["name", "status"], lambda c: remove_punctuation(f"lower({strip(c)})"))
)

# -- types and standard forms ------------------------------------------------------------------

FIRST_DATE = "(SELECT arg_min(signup_date, row_id) FROM contacts WHERE signup_date IS NOT NULL)"
DATE = (
    rf"CASE WHEN regexp_matches({FIRST_DATE}, '^\d{{4}}-\d') "
    "THEN try_strptime(signup_date, '%Y-%m-%d') ELSE try_strptime(signup_date, '%m/%d/%Y') END"
)
ORACLE["coerce_numeric"] = changed(amount=number("amount"), zip=number("zip"))
ORACLE["coerce_numeric_currency"] = changed(amount=number("amount", True))
ORACLE["coerce_datetime_format"] = changed(signup_date="try_strptime(signup_date, '%m/%d/%Y')")
ORACLE["coerce_datetime_inferred"] = changed(signup_date=DATE)
ORACLE["phone_us"] = changed(phone=keep(phone_us("phone"), "phone"))
ORACLE["phone_us_local"] = changed(phone=keep(phone_us("phone", ""), "phone"))
ORACLE["phone_digits"] = changed(phone=keep(phone_digits("phone"), "phone"))
ORACLE["phone_e164"] = changed(phone=keep(f"'+1' || {phone_digits('phone')}", "phone"))
ORACLE["zip5"] = changed(zip=keep(zip_code("zip"), strip("zip")))
ORACLE["zip9"] = changed(zip=keep(zip_code("zip", True), strip("zip")))
ORACLE["state_abbr"] = changed(state=keep(state("state"), "state"))
ORACLE["state_name"] = changed(state=keep(state("state", True), "state"))

# -- whole step lists --------------------------------------------------------------------------


def contact_steps(columns: list[str], *layers: dict[str, str], select: str) -> str:
    return contacts(select, chain(columns, "contacts", *layers))


ORACLE["config_all_modules"] = contact_steps(
    ["row_id", "name", "phone", "zip", "state", "status", "cust"],
    {c: f"CASE WHEN {strip(c)} IN ('', '-', 'y') THEN NULL ELSE {c} END" for c in ("status", "zip")},
    each(["name", "phone", "zip", "state", "status"], strip),
    {"state": replaced("state", {"texas": "TX", "ny": "NY", "TX": "Texas"}), "status": "upper(coalesce(status, 'none'))"},
    select="SELECT cust AS customer, status AS remark, state, coalesce(zip, '00000') AS zip FROM t3 "
    "WHERE cust IS NOT NULL AND (status <> 'NONE' OR zip IS NOT NULL) "
    "QUALIFY row_number() OVER (PARTITION BY cust, status ORDER BY row_id DESC) = 1",
)
_known = [c for c in UNNUMBERED if c != "mostly_empty"]
ORACLE["config_validation"] = contact_steps(
    UNNUMBERED,
    {
        "amount": f"CAST(CAST({number('amount', True)} AS FLOAT) AS FLOAT)",
        "zip": number("zip", True),
        "signup_date": "try_strptime(signup_date, '%Y-%m-%d')",
        "state": "coalesce(state, '?')",
        "status": "coalesce(status, '?')",
        "phone": keep(f"'+1' || {phone_digits('phone')}", "phone"),
    },
    select=f"SELECT {pick(_known)} FROM t1 WHERE zip IS NOT NULL OR phone IS NOT NULL "
    f"GROUP BY ALL HAVING count(*) = 1",
)
ORACLE["config_contacts"] = contact_steps(
    COLUMNS,
    {
        "state": keep(state("state", True), "state"),
        "zip": keep(zip_code("zip", True), strip("zip")),
        "name": collapse(remove_control("name")),
    },
    each(["name", "state"], lambda c: strip(collapse(f"lower({strip(c)})"))),
    {"name": title("name")},
    select="SELECT * FROM t3",
)
CRM = (
    each(TEXT, strip),
    each(TEXT, lambda c: null_if(c, ["n/a", "N/A", "none", "-"])),
    each(TEXT, lambda c: f"lower({c})"),
    {
        "phone": keep(phone_us("phone"), "phone"),
        "zip": keep(zip_code("zip"), strip("zip")),
        "state": keep(state("state"), "state"),
    },
)
LEADS = (
    each(TEXT, strip),
    each(TEXT, lambda c: f"lower({c})"),
    {"state": keep(state("state"), "state")},
)
ORACLE["preset_crm"] = contact_steps(UNNUMBERED, *CRM, select="SELECT DISTINCT * FROM t4")
ORACLE["preset_leads"] = contact_steps(UNNUMBERED, *LEADS, select="SELECT DISTINCT * FROM t3")

CONTENTS = ["text", "lang", "source", "n_chars"]
WORDS = ["text", "lang", "source"]
SCRAPE = chain(
    CONTENTS,
    "documents",
    each(WORDS, strip),
    each(WORDS, lambda c: strip(collapse(remove_control(c)))),
    each(WORDS, lambda c: null_if(c, ["n/a", "N/A"])),
    each(WORDS, lambda c: f"lower({c})"),
)
ORACLE["preset_scrape"] = (
    f"WITH {SCRAPE} SELECT DISTINCT * FROM t4 WHERE text IS NOT NULL OR lang IS NOT NULL "
    "OR source IS NOT NULL OR n_chars IS NOT NULL"
)
ORACLE["custom_step"] = contact_steps(
    UNNUMBERED,
    each(TEXT, strip),
    select=f"SELECT DISTINCT *, substr({digits('phone')}, 1, 3) AS area_code FROM t1 "
    f"WHERE {digits('phone')} <> ''",
)

_code = f"substr({digits('phone')}, 1, 3)"
_called = f"{digits('phone')} <> ''"
ORACLE["custom_step_ordered"] = contacts(
    f"SELECT *, {_code} AS area_code FROM contacts WHERE {_called} "
    "QUALIFY row_number() OVER (PARTITION BY area_code, status ORDER BY row_id) = 1"
)
ORACLE["custom_step_scoped"] = contacts(
    f"SELECT *, {_code} AS area_code FROM contacts WHERE {_called} "
    "QUALIFY row_number() OVER (PARTITION BY state, status ORDER BY row_id DESC) = 1"
)
ORACLE["custom_step_report"] = contacts(
    "SELECT (SELECT count(*) FROM contacts WHERE name IS NULL) AS rows_dropped, "
    "(SELECT count(*) FROM contacts WHERE name IS NOT NULL) AS rows_before, count(*) AS rows_after, "
    f"count(*) - count(DISTINCT {_code}) AS duplicates_removed, count(DISTINCT {_code}) AS rows_output "
    f"FROM contacts WHERE name IS NOT NULL AND {_called}"
)

# -- results of runs together ------------------------------------------------------------------

TRIMMED = (each(TEXT, strip), each(TEXT, lambda c: null_if(c, ["n/a"])))
_both = "name IS NOT NULL AND status IS NOT NULL"
# A blank name is not null when the first filter looks, and becomes null afterwards.
_given = "EXISTS (SELECT 1 FROM contacts c WHERE c.row_id = t2.row_id AND c.name IS NOT NULL)"
ORACLE["union_of_cleaned"] = contact_steps(
    COLUMNS, *TRIMMED, select=f"SELECT * FROM t2 WHERE {_given} AND status IS NOT NULL"
)
ORACLE["join_of_cleaned"] = contact_steps(
    COLUMNS,
    *TRIMMED,
    select=f"SELECT t2.row_id, t2.name, c.zip FROM t2 JOIN contacts c USING (row_id) "
    f"WHERE c.name IS NOT NULL AND t2.status IS NOT NULL AND c.zip IS NOT NULL",
)
ORACLE["clean_twice"] = contact_steps(
    COLUMNS, *TRIMMED, select=f"SELECT * FROM t2 WHERE {_both} AND zip IS NOT NULL"
)

# -- NaN, types ----------------------------------------------------------------------------------

ORACLE["nan_is_null"] = (
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE CAST(o_totalprice AS DOUBLE) END AS price, "
    "CAST(o_custkey AS DOUBLE) AS cust, 'double' AS price_type, 'bigint' AS cust_type FROM orders WHERE o_orderkey % 53 <> 0"
)
_range = "(SELECT max(o_orderkey) FROM orders)"
ORACLE["coerce_numeric_downcast_integer"] = (
    "SELECT o_orderkey AS id, CAST(o_orderkey % 100 AS DOUBLE) AS small, o_orderkey * 1000.0::DOUBLE AS whole, "
    "(o_orderkey % 1000) / 4 AS quarter, 'tinyint' AS small_type, "
    f"CASE WHEN {_range} * 1000 < 32768 THEN 'smallint' WHEN {_range} * 1000 < 2147483648 THEN 'int' ELSE 'bigint' END AS whole_type, "
    "'double' AS quarter_type FROM orders"
)
ORACLE["coerce_numeric_downcast_float"] = (
    "SELECT o_orderkey AS id, (o_orderkey % 1000) / 4 AS quarter, o_orderkey + 1e6 + CAST(0.1 AS DOUBLE) AS tenth, "
    "'float' AS quarter_type, 'double' AS tenth_type FROM orders"
)
ORACLE["fill_nulls_no_nulls"] = (
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_custkey AS STRING) ELSE '?' END AS cust, "
    "CAST(o_orderkey * 1000 AS STRING) AS whole, CAST(o_orderkey AS DOUBLE) AS full, 'string' AS cust_type, "
    "'string' AS whole_type, 'bigint' AS full_type FROM orders"
)
ORACLE["infer_types_nullable_long"] = (
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS cust, "
    "(o_orderkey % 1000) / 4 AS quarter, 'bigint' AS cust_type, 'double' AS quarter_type FROM orders"
)

# -- metrics and reports -----------------------------------------------------------------------


def total(*conditions: str) -> str:
    """How many cells meet their condition; no rows at all count as 0."""
    return "coalesce(sum(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + "), 0)"


def differing(columns: list[str], change) -> str:
    return total(*[f"{c} <> {change(c)}" for c in columns])


ORACLE["metrics_text"] = (
    f"WITH {chain(DOCUMENTS, 'documents', each(WORDS, strip), each(WORDS, remove_control), each(WORDS, lambda c: null_if(c, ['en', 'n/a'])))} "
    f"SELECT (SELECT count(*) FROM documents) AS rows_loaded, "
    f"(SELECT {differing(WORDS, strip)} FROM documents) AS trimmed, "
    f"(SELECT {differing(WORDS, remove_control)} FROM t1) AS control_removed, "
    f"(SELECT {total(*[f'{c} IS NOT NULL AND {null_if(c, ["en", "n/a"])} IS NULL' for c in WORDS])} FROM t2) AS emptied, "
    f"(SELECT {differing(WORDS, match_key)} FROM t3) AS matching_changed"
)


def made(old: str, new: str) -> str:
    return total(f"{old} IS NOT NULL AND ({new}) IS NOT NULL")


def missed(old: str, new: str) -> str:
    return total(f"{old} IS NOT NULL AND ({new}) IS NULL")


ORACLE["metrics_validation"] = contacts(
    f"SELECT {made('amount', number('amount', True))} AS numbers_converted, "
    f"{missed('amount', number('amount', True))} AS numbers_failed, "
    f"{made('signup_date', DATE)} AS dates_converted, {missed('signup_date', DATE)} AS dates_failed, "
    f"{total(f'phone <> {phone_us("phone")}')} AS phones_changed, "
    f"{missed('phone', phone_us('phone'))} AS phones_invalid, "
    f"{total(f'{strip("zip")} <> {zip_code("zip")}')} AS zips_changed, "
    f"{missed('zip', zip_code('zip'))} AS zips_invalid, "
    f"{total(f'lower({strip("state")}) <> lower({state("state")})')} AS states_changed, "
    f"{missed('state', state('state'))} AS states_unmapped, "
    f"{total('status IS NULL', 'name IS NULL')} AS nulls_filled FROM contacts"
)


def replacements(mapping: dict) -> str:
    conditions = []
    for c in TEXT:
        done: dict = {}
        for old, new in mapping.items():
            conditions.append(f"{replaced(c, done)} = '{old}'")
            done = {**done, old: new}
    return total(*conditions)


ORACLE["metrics_replace"] = contacts(f"SELECT {replacements(REPLACED)} AS replacements FROM contacts")
_crm = chain(UNNUMBERED, "contacts", *CRM)
_crm_empty = ["n/a", "N/A", "none", "-"]
_crm_metrics = [
    (0, "text.trim_whitespace", "cells_changed", differing(TEXT, strip), "contacts"),
    (
        1,
        "text.normalize_empty_strings",
        "values_replaced",
        total(*[f"{c} IS NOT NULL AND {null_if(c, _crm_empty)} IS NULL" for c in TEXT]),
        "t1",
    ),
    (3, "validation.standardize_phone", "values_changed", total(f"phone <> {phone_us('phone')}"), "t3"),
    (3, "validation.standardize_phone", "values_invalid", missed("phone", phone_us("phone")), "t3"),
    (4, "validation.standardize_zip", "values_changed", total(f"{strip('zip')} <> {zip_code('zip')}"), "t3"),
    (4, "validation.standardize_zip", "values_invalid", missed("zip", zip_code("zip")), "t3"),
    (
        5,
        "validation.standardize_state",
        "values_changed",
        total(f"lower({strip('state')}) <> lower({state('state')})"),
        "t3",
    ),
    (5, "validation.standardize_state", "values_unmapped", missed("state", state("state")), "t3"),
    (
        6,
        "dedupe.drop_duplicates",
        "duplicates_removed",
        "(SELECT count(*) FROM t4) - count(*)",
        "(SELECT DISTINCT * FROM t4)",
    ),
    (
        7,
        "core.drop_rows_missing_required",
        "rows_dropped",
        total("phone IS NULL"),
        "(SELECT DISTINCT * FROM t4)",
    ),
]
ORACLE["metrics_by_step"] = contacts(
    " UNION ALL ".join(
        f"SELECT {at} AS position, '{step}' AS step, '{metric}' AS metric, "
        f"CAST({value} AS BIGINT) AS value FROM {source}"
        for at, step, metric, value, source in _crm_metrics
    ),
    _crm,
)
ORACLE["report_row_crm"] = contacts(
    "SELECT loaded AS rows_loaded, kept AS rows_output, loaded - kept AS rows_removed, "
    "loaded - distinct_rows AS duplicates_removed, distinct_rows - kept AS rows_dropped, "
    "9 AS steps_run FROM (SELECT (SELECT count(*) FROM t4) AS loaded, count(*) AS distinct_rows, "
    "count(*) FILTER (phone IS NOT NULL AND name IS NOT NULL) AS kept FROM (SELECT DISTINCT * FROM t4))",
    _crm,
)
ORACLE["report_per_source"] = (
    f"WITH {SCRAPE}, cleaned AS (SELECT documents.source AS origin, lower({strip('documents.source')}) "
    "AS key, count(*) AS loaded FROM documents GROUP BY ALL), "
    "distinct_rows AS (SELECT source, count(*) AS kept FROM (SELECT DISTINCT * FROM t4) GROUP BY source), "
    f"trimmed AS (SELECT source AS origin, {differing(WORDS, strip)} AS cells FROM documents GROUP BY source) "
    "SELECT cleaned.origin AS source, loaded AS rows_loaded, kept AS rows_output, "
    "loaded - kept AS duplicates_removed, cells AS cells_trimmed FROM cleaned "
    "JOIN distinct_rows ON cleaned.key = distinct_rows.source JOIN trimmed ON trimmed.origin = cleaned.origin"
)

_leads = chain(UNNUMBERED, "contacts", *LEADS)


def _renamed(subqueries: str, prefix: str) -> str:
    """The subqueries t1, t2, ... under names of their own."""
    for i in range(9, 0, -1):
        subqueries = subqueries.replace(f"t{i} AS (", f"{prefix}{i} AS (").replace(
            f"FROM t{i})", f"FROM {prefix}{i})"
        )
    return subqueries


_three_runs = [_renamed(_crm, "crm"), _renamed(_leads, "leads"), _renamed(SCRAPE, "scrape")]
ORACLE["run_totals"] = contacts(
    "SELECT 3 AS files_cleaned, (SELECT count(*) FROM (SELECT DISTINCT * FROM crm4)) "
    "+ (SELECT count(*) FROM (SELECT DISTINCT * FROM leads3)) "
    "+ (SELECT count(*) FROM (SELECT DISTINCT * FROM scrape4)) AS rows_processed",
    *_three_runs,
)


def _counted(value: str, source: str) -> str:
    return f"(SELECT CAST({value} AS BIGINT) FROM {source})"


def _duplicates(source: str) -> str:
    return f"(SELECT (SELECT count(*) FROM {source}) - count(*) FROM (SELECT DISTINCT * FROM {source}))"


_emptied = total(*[f"{c} IS NOT NULL AND {null_if(c, _crm_empty)} IS NULL" for c in TEXT])
_scrape_emptied = total(*[f"{c} IS NOT NULL AND {null_if(c, ['n/a', 'N/A'])} IS NULL" for c in WORDS])
_state_changed = total(f"lower({strip('state')}) <> lower({state('state')})")
_state_unmapped = missed("state", state("state"))
_trims = [_counted(differing(TEXT, strip), "contacts")] * 2 + [
    _counted(differing(WORDS, strip), "documents")
]
_module_stats = [
    ("core.drop_empty", "dropped_empty", 1, "0"),
    (
        "dedupe.drop_duplicates",
        "duplicates_removed",
        3,
        " + ".join(map(_duplicates, ["crm4", "leads3", "scrape4"])),
    ),
    ("text.normalize_case", "columns_normalized", 3, "8 + 8 + 3"),
    ("text.normalize_empty_strings", "columns_processed", 2, "8 + 3"),
    (
        "text.normalize_empty_strings",
        "values_replaced",
        2,
        f"{_counted(_emptied, 'crm1')} + {_counted(_scrape_emptied, 'scrape2')}",
    ),
    ("text.remove_non_printable", "columns_processed", 1, "3"),
    (
        "text.remove_non_printable",
        "values_changed",
        1,
        _counted(differing(WORDS, lambda c: strip(collapse(remove_control(c)))), "scrape1"),
    ),
    ("text.trim_whitespace", "cells_changed", 3, " + ".join(_trims)),
    ("text.trim_whitespace", "columns_trimmed", 3, "8 + 8 + 3"),
    ("validation.standardize_phone", "columns_processed", 2, "1 + 0"),
    (
        "validation.standardize_phone",
        "values_changed",
        2,
        _counted(total(f"phone <> {phone_us('phone')}"), "crm3"),
    ),
    (
        "validation.standardize_phone",
        "values_invalid",
        2,
        _counted(missed("phone", phone_us("phone")), "crm3"),
    ),
    ("validation.standardize_state", "columns_processed", 2, "1 + 1"),
    (
        "validation.standardize_state",
        "values_changed",
        2,
        f"{_counted(_state_changed, 'crm3')} + {_counted(_state_changed, 'leads2')}",
    ),
    (
        "validation.standardize_state",
        "values_unmapped",
        2,
        f"{_counted(_state_unmapped, 'crm3')} + {_counted(_state_unmapped, 'leads2')}",
    ),
    ("validation.standardize_zip", "columns_processed", 1, "1"),
    (
        "validation.standardize_zip",
        "values_changed",
        1,
        _counted(total(f"{strip('zip')} <> {zip_code('zip')}"), "crm3"),
    ),
    (
        "validation.standardize_zip",
        "values_invalid",
        1,
        _counted(missed("zip", zip_code("zip")), "crm3"),
    ),
]
ORACLE["run_module_stats"] = contacts(
    " UNION ALL ".join(
        f"SELECT '{step}' AS step, '{metric}' AS metric, CAST({runs} AS BIGINT) AS runs, "
        f"CAST({value} AS BIGINT) AS total"
        for step, metric, runs, value in _module_stats
    ),
    *_three_runs,
)

# -- chunks, unions, streams -------------------------------------------------------------------

ORACLE["chunked_dedupe"] = contacts(
    "SELECT * FROM contacts QUALIFY row_number() OVER "
    "(PARTITION BY row_id // 1000, state, status ORDER BY row_id) = 1"
)
ORACLE["chunked_empty_columns"] = contacts(
    f"SELECT {pick([c for c in COLUMNS if c != 'mostly_empty'])}, "
    f"CASE WHEN bool_or({strip('note')} <> '') OVER (PARTITION BY row_id // 1000) "
    "THEN coalesce(note, 'none') END AS note FROM noted",
    "noted AS (SELECT *, CASE WHEN (row_id // 1000) % 2 = 0 THEN status ELSE ' ' END AS note FROM contacts)",
)
ORACLE["chunked_report"] = contacts(
    "SELECT row_id // 1000 AS chunk, count(*) AS rows_loaded, "
    "count(*) FILTER (phone IS NULL) AS rows_dropped, "
    "count(*) FILTER (phone IS NOT NULL) - count(DISTINCT CASE WHEN phone IS NOT NULL "
    "THEN coalesce(state, '?none') END) AS duplicates_removed, "
    "count(DISTINCT CASE WHEN phone IS NOT NULL THEN coalesce(state, '?none') END) AS rows_output "
    "FROM contacts GROUP BY 1"
)
ORACLE["union_of_chunks"] = contacts(
    "SELECT row_id, name, phone, NULL AS zip FROM contacts "
    "UNION ALL SELECT row_id, NULL, NULL, zip FROM contacts"
)
ORACLE["stream_rowwise"] = (
    f"WITH {chain(DOCUMENTS, 'documents', each(WORDS, strip), {'text': match_key('text')})} SELECT * FROM t2"
)
ORACLE["stream_dedupe_across_batches"] = contacts(
    "SELECT * FROM trimmed QUALIFY row_number() OVER (PARTITION BY state, status ORDER BY (row_id + 1) % 3, row_id) = 1",
    f"trimmed AS (SELECT row_id, {strip('state')} AS state, {strip('status')} AS status, {strip('phone')} AS phone FROM contacts)",
)
ORACLE["stream_dates_two_batches"] = (
    "SELECT o_orderkey, make_timestamp(2024, 1 + o_orderkey % 7, CASE WHEN o_orderkey % 2 = 1 THEN 1 + o_orderkey % 12 "
    "ELSE 13 + o_orderkey % 15 END, 0, 0, 0) AS day, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey * 1000 ELSE o_orderkey % 100 END AS amount, "
    "CASE WHEN o_orderkey % 2 = 1 THEN 'b' END AS note FROM orders"
)
_named = ["name", "state", "status"]
_absent = " OR ".join(f"coalesce({strip(c)}, '') = ''" for c in ("name", "state"))
ORACLE["stream_report"] = contacts(
    f"SELECT step, metric, total, (SELECT count(*) FROM contacts) AS rows_loaded, (SELECT count(*) FROM contacts WHERE NOT ({_absent})) AS rows_output, "
    f"(SELECT count(*) FROM contacts WHERE {_absent}) AS rows_dropped FROM ("
    f"SELECT 'text.trim_whitespace' AS step, 'cells_changed' AS metric, (SELECT {differing(_named, strip)} FROM contacts) AS total "
    "UNION ALL SELECT 'text.normalize_empty_strings', 'values_replaced', "
    f"(SELECT {total(*[f'{strip(c)} = {chr(39) * 2}' for c in _named])} FROM contacts) "
    f"UNION ALL SELECT 'core.drop_rows_missing_required', 'rows_dropped', (SELECT count(*) FROM contacts WHERE {_absent}))"
)
ORACLE["run_totals_incremental"] = contacts(
    "SELECT step, metric, 2 AS runs, total, 4 AS files_cleaned, (SELECT count(*) + count(phone) FROM contacts) AS rows_processed FROM ("
    f"SELECT 'text.trim_whitespace' AS step, 'cells_changed' AS metric, (SELECT {differing(TEXT, strip)} FROM contacts) AS total "
    "UNION ALL SELECT 'core.drop_rows_missing_required', 'rows_dropped', (SELECT count(*) FROM contacts WHERE phone IS NULL))"
)
ORACLE["stream_batches"] = ORACLE["preset_scrape"]

# -- sources and sinks -------------------------------------------------------------------------

NULLS = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
NULLS += "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
_tokens = each(TEXT, lambda c: f"CASE WHEN {c} NOT IN {NULLS} THEN {c} END")
ORACLE["scan_null_tokens"] = changed(**_tokens)
ORACLE["scan_csv"] = changed(**_tokens)
ORACLE["infer_types_contacts"] = contacts(
    "SELECT row_id, cust, row_id / 4 AS ratio, row_id % 3 = 0 AS third, "
    "CASE WHEN cust IS NOT NULL THEN 'true' END AS has_cust, amount, signup_date FROM contacts"
)
ORACLE["scan_csv_multiline"] = "SELECT * FROM documents"
ORACLE["scan_csv_chunked"] = (
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, "
    "(row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders) QUALIFY row_number() "
    "OVER (PARTITION BY chunk, o_orderstatus, o_orderpriority ORDER BY o_orderkey) = 1"
)
ORACLE["scan_csv_chunked_types"] = (
    f"WITH n AS (SELECT o_orderkey, {CODE} AS code, {RATIO} AS ratio, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders) "
    "SELECT o_orderkey, CAST(ratio AS DOUBLE) AS ratio, CASE WHEN bool_or(code = 'n/k') OVER (PARTITION BY chunk) "
    "THEN code ELSE CAST(try_cast(code AS BIGINT) AS VARCHAR) END AS code FROM n"
)
ORACLE["chunked_after_sort"] = (
    "WITH n AS (SELECT count(*) AS n FROM orders) "
    "SELECT chunk, least(100, n - 100 * chunk) AS rows_loaded FROM n, LATERAL (SELECT unnest(range((n + 99) // 100)) AS chunk)"
)
ORACLE["union_of_types"] = (
    "WITH d AS (SELECT o_orderkey AS k, DATE '2024-01-01' + CAST(o_orderkey % 300 AS INTEGER) AS day FROM orders) "
    "SELECT k AS o_orderkey, CAST(k AS VARCHAR) AS code, CAST(k AS DOUBLE) AS half, CAST(day AS VARCHAR) AS day, CAST(day AS TIMESTAMP) AS due FROM d "
    "UNION ALL SELECT k, 'k' || k, k / 2, 'day ' || (k % 300), CAST(day AS TIMESTAMP) + INTERVAL 5 HOUR FROM d"
)
ORACLE["scan_json"] = contacts("SELECT * FROM contacts")
ORACLE["json_flatten"] = (
    "SELECT doc_id, lang AS meta_lang, source AS meta_from_name, n_chars AS meta_from_n_chars, "
    "len(string_split(text, ' ')) AS n_words FROM documents"
)
ORACLE["scan_yaml"] = "SELECT * FROM customer"
ORACLE["sink_csv_roundtrip"] = contacts(
    "SELECT "
    + pick(
        COLUMNS,
        **each(TEXT, lambda c: f"nullif({c}, '')"),
        row_id="CAST(row_id AS STRING)",
        cust="CAST(cust AS STRING)",
    ).replace(
        "nullif(signup_date, '')", "strftime(try_strptime(signup_date, '%Y-%m-%d'), '%Y-%m-%d')"
    )
    + " FROM contacts"
)
ORACLE["sink_json_roundtrip"] = "SELECT * REPLACE (epoch_ms(o_orderdate) AS o_orderdate) FROM orders"
ORACLE["sink_yaml_roundtrip"] = "SELECT * FROM supplier"

ORACLE["chunked_after_filter"] = (
    "WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0) "
    "SELECT chunk, least(100, n - 100 * chunk) AS rows_loaded FROM n, LATERAL (SELECT unnest(range((n + 99) // 100)) AS chunk)"
)
ORACLE["stream_of_two_batches"] = contacts(
    "SELECT state, status FROM (SELECT DISTINCT state, status, row_id % 2 FROM contacts)"
)

ORACLE["scan_csv_crlf"] = f"SELECT doc_id, {CRLF_TEXT} AS text, source FROM documents"
ORACLE["scan_csv_dialects"] = contacts(
    "SELECT row_id, name, phone, CASE WHEN row_id % 5 = 0 THEN 'é;' || chr(10) || '''' || status END AS note FROM contacts WHERE name NOT LIKE '%€%' "
    "UNION ALL SELECT row_id, replace(name, chr(9), chr(9) || ' '), NULL, NULL FROM contacts"
)
_tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
ORACLE["scan_null_tokens_all"] = contacts(
    f"SELECT row_id, CASE WHEN row_id % 2 = 1 THEN [{_tokens}][row_id % {len(NULL_TOKENS)} + 1] || ' ' END AS cell FROM contacts"
)
ORACLE["scan_json_list"] = contacts("SELECT row_id, name, zip, cust FROM contacts")
ORACLE["scan_json_list_split"] = (
    "SELECT doc_id, lang, 2 AS n_from, source, '}]\"{[\\' || text || '\\\"}' AS text FROM documents"
)
ORACLE["scan_json_many_keys"] = contacts(
    "SELECT row_id, name, '{\"k' || (row_id % 100000) || '\":' || coalesce('\"' || state || '\"', 'null') || '}' AS rest FROM contacts"
)
ORACLE["scan_json_objects"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
ORACLE["clean_csv_file"] = contact_steps(
    COLUMNS,
    each(TEXT, lambda c: f"CASE WHEN {c} NOT IN ({_tokens}) THEN {c} END"),
    each(TEXT, strip),
    {"state": keep(state("state"), "state")},
    select="SELECT row_id, nullif(name, '') AS name, nullif(state, '') AS state, cust, "
    "(SELECT count(*) FROM t3 WHERE name IS NOT NULL) AS rows_output FROM t3 WHERE name IS NOT NULL",
)
_emptied_rows = (
    "emptied AS (SELECT " + pick(UNNUMBERED, **each(UNNUMBERED, lambda c: f"CASE WHEN row_id % 41 <> 0 THEN {c} END")) + " FROM contacts)",
    chain(UNNUMBERED, "emptied", each(TEXT, strip), each(TEXT, lambda c: null_if(c, []))),
)
ORACLE["report_empty_rows"] = contacts(
    f"SELECT (SELECT count(*) FROM t2) AS rows_loaded, (SELECT count(*) FROM t2 WHERE NOT ({_some})) AS rows_dropped, "
    f"(SELECT count(*) FROM t2 WHERE {_some}) - count(*) AS duplicates_removed, count(*) AS rows_output, "
    f"(SELECT count(*) FROM t2 WHERE NOT ({_some})) AS dropped_empty FROM (SELECT DISTINCT * FROM t2 WHERE {_some})",
    *_emptied_rows,
)
