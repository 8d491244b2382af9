"""DuckDB SQL that gives the same rows as the query of the same name."""

from __future__ import annotations

import re

from scriptorium.functions import text as t
from scriptorium.functions import validate as v
from scriptorium.functions.checksum import INVERSE, PERMUTED, PRODUCT
from scriptorium.operators import extract as e
from scriptorium.operators import response as r
from scriptorium.operators import spatial as sp
from scriptorium.operators.imaging import AUGMENTATIONS, DEFAULTS
from scriptorium.plans.fixtures import IFSC_CODES, PIN_CODES
from scriptorium.queries import BOXES

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(text(x) if isinstance(x, str) else str(x) for x in items)


def verhoeff(digits: str, shift: int) -> str:
    """The running product over a string of digits."""
    digit = f"ascii(substr(reverse({digits}), (i + 1)::int, 1)) - 48"
    return f"list_reduce(range(0, length({digits})), lambda c, i: ([{values(PRODUCT)}])[c * 10 + ([{values(PERMUTED)}])[(i + {shift}) % 8 * 10 + {digit} + 1] + 1], 0::bigint)"


def norm(x: str) -> str:
    return rf"upper(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def digits(x: str) -> str:
    return f"translate({x}, {text(t.DIGIT_FROM)}, {text(t.DIGIT_TO)})"


def letters(x: str) -> str:
    return f"translate({x}, {text(t.ALPHA_FROM)}, {text(t.ALPHA_TO)})"


def title(x: str) -> str:
    """Title case of words with single spaces."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


def mask(x: str) -> str:
    return f"case when length(replace({x}, ' ', '')) = 12 then 'XXXX XXXX ' || right(replace({x}, ' ', ''), 4) else {x} end"


def cer(p: str, g: str) -> str:
    a, b = norm(p), norm(g)
    return f"case when length({b}) = 0 then case when {a} = '' then 0.0 else 1.0 end else levenshtein({a}, {b})::double / length({b}) end"


def words(x: str) -> str:
    return f"case when {norm(x)} = '' then []::varchar[] else string_split({norm(x)}, ' ') end"


def wer(p: str, g: str) -> str:
    """Edit distance of words: a fold over rows of the table, each a fold over its cells."""
    a, b = words(p), words(g)
    cell = f"list_append(o, least(w[j] + (case when x = ({b})[j] then 0 else 1 end), w[j + 1] + 1, o[j] + 1))"
    row = f"list_reduce(range(1, len({b}) + 1), lambda o, j: {cell}, [w[1] + 1])"
    # the fold over words carries a struct, so that rows and words have one type
    rows = f"list_reduce(list_transform({a}, lambda y: {{'x': y, 'w': []::bigint[]}}), lambda s, q: {{'x': '', 'w': {row.replace('w[', 's.w[').replace('x = ', 'q.x = ')}}}, {{'x': '', 'w': range(0, len({b}) + 1)}}).w"
    return f"case when len({b}) = 0 then case when len({a}) = 0 then 0.0 else 1.0 end else ({rows})[-1]::double / len({b}) end"


def letter(x: str) -> str:
    return f"chr((65 + ({x}) % 26)::int)"


_BODY = "((2 + k % 8) * 10000000000 + (k * 7919 + 1234567) % 10000000000)::bigint::varchar"
_UID11 = f"({_BODY} || (([{values(INVERSE)}])[{verhoeff(_BODY, 1)} + 1])::varchar)"
UID = f"substr({_UID11}, 1, 4) || ' ' || substr({_UID11}, 5, 4) || ' ' || substr({_UID11}, 9, 4)"
PAN = f"{letter('k')} || {letter('k // 26')} || {letter('3 * k')} || substr('PCHFATBLGJ', (1 + k % 10)::int, 1) || {letter('7 * k')} || lpad((1 + 37 * k % 9999)::varchar, 4, '0') || {letter('11 * k')}"
DOB = "lpad((1 + k % 28)::varchar, 2, '0') || '/' || lpad((1 + k % 12)::varchar, 2, '0') || '/' || (1950 + k % 50)::varchar"
PIN = f"substr('{''.join(PIN_CODES)}123456', (1 + k % 5 * 6)::int, 6)"
RAW = "case k % 4 when 0 then gt when 1 then translate(gt, '0158', 'OISB') when 2 then left(gt, length(gt) - 1) else ' ' || lower(gt) || '  ' end"

FIELDS = f"""
named as (select c_custkey as k, p_name from customer join part on p_partkey = c_custkey),
listed as (
  select k, 1 as ord, 'uid' as field_name, {UID} as gt from named union all
  select k, 2, 'pan_number', {PAN} from named union all
  select k, 3, 'dob', {DOB} from named union all
  select k, 4, 'name', p_name from named union all
  select k, 5, 'pincode', {PIN} from named
),
fields as (
  select k, 'c' || k::varchar as id, ord, field_name, gt, {RAW} as raw,
    k % 13 <> 0 and not (field_name = 'pincode' and k % 11 = 0) as present, ((31 * k + 7 * ord) % 100) / 100.0::double as conf
  from listed
)
"""


def correct_digits(x: str, n: int) -> str:
    number = digits(rf"regexp_replace({x}, '[^\pL\pN_]', '', 'g')")
    shown = f"{number}" if n == 6 else f"substr({number}, 1, 4) || ' ' || substr({number}, 5, 4) || ' ' || substr({number}, 9, 4)"
    return f"case when regexp_full_match({number}, '[0-9]{{{n}}}') then {shown} else {x} end"


def correct_pan(x: str) -> str:
    clean = f"upper(replace({x}, ' ', ''))"
    fixed = f"({letters(f'substr({clean}, 1, 5)')} || {digits(f'substr({clean}, 6, 4)')} || {letters(f'substr({clean}, 10, 1)')})"
    return f"case when length({clean}) = 10 and regexp_full_match({fixed}, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') then {fixed} else {x} end"


def correct_date(x: str) -> str:
    fixed = digits(rf"translate({x}, '-.\', '///')")
    first = f"regexp_extract({fixed}, '([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', 1)"
    part = lambda at, n: f"try_cast(substr({first}, {at}, {n}) as int)"
    year = rf"regexp_extract({fixed}, '\b((?:19|20)[0-9]{{2}})\b', 1)"
    return f"case when {part(1, 2)} between 1 and 31 and {part(4, 2)} between 1 and 12 and {part(7, 4)} between 1900 and 2100 then {first} when {year} <> '' then {year} else {x} end"


def correct_name(x: str) -> str:
    return title(rf"trim(regexp_replace(regexp_replace({x}, '[^a-zA-Z\s]', '', 'g'), '\s+', ' ', 'g'))")


def correct_field(name: str, x: str) -> str:
    """By the five names of the derived fields."""
    return f"case {name} when 'uid' then {correct_digits(x, 12)} when 'pan_number' then {correct_pan(x)} when 'dob' then {correct_date(x)} when 'name' then {correct_name(x)} when 'pincode' then {correct_digits(x, 6)} end"


def trimmed_field(name: str, x: str) -> str:
    return f"case when {correct_field(name, x)} = {x} and {name} not in ('uid', 'pan', 'dob', 'name', 'pincode') then {strip(x)} else {correct_field(name, x)} end"


def uid_error(x: str) -> str:
    clean = strip(f"replace({x}, ' ', '')")
    return f"""case when not regexp_full_match({clean}, '[0-9]+') then 'UID contains non-numeric characters'
      when length({clean}) <> 12 then 'UID must be exactly 12 digits (found ' || length({clean})::varchar || ')'
      when left({clean}, 1) in ('0', '1') then 'UID cannot start with 0 or 1'
      when {verhoeff(f"case when regexp_full_match({clean}, '[0-9]+') then {clean} else '0' end", 0)} = 0 then '' else 'Verhoeff checksum failed' end"""


def form(x: str, pattern: str, error: str) -> str:
    return f"case when regexp_matches({x}, {text(pattern)}) then '' else {text(error)} end"


def pan_error(x: str) -> str:
    return form(f"upper({strip(x)})", v.PAN_FORM, v.PAN_ERROR)


def pin_error(x: str) -> str:
    return f"case when not regexp_matches({strip(x)}, {text(v.PIN_FORM)}) then {text(v.PIN_ERROR)} when {strip(x)} not in ({values(PIN_CODES)}) then {text(v.PIN_UNKNOWN)} else '' end"


def date_error(x: str) -> str:
    """As of 1 June 2024."""
    clean = strip(x)
    date = f"try_strptime({clean}, '%d/%m/%Y')"
    year, month, day = (f"try_cast(substr({clean}, {at}, {n}) as int)" for at, n in ((7, 4), (4, 2), (1, 2)))
    return f"""case when regexp_matches({clean}, {text(v.YEAR_FORM)}) and 2024 - try_cast({clean} as int) between 0 and 120 then ''
      when not regexp_matches({clean}, {text(v.DATE_FORM)}) then 'Date must be DD/MM/YYYY or YYYY' when {date} is null then 'Invalid calendar date'
      when {year} < 1900 then 'Year before 1900' when {date} > timestamp '2024-06-01' then 'Date is in the future'
      when 2024 - {year} - (case when {month} * 100 + {day} > 601 then 1 else 0 end) > 120 then 'Age exceeds 120 years' else '' end"""


def field_error(name: str, x: str) -> str:
    return f"case when {x} = '' then 'Field is empty' else case {name} when 'uid' then {uid_error(x)} when 'pan_number' then {pan_error(x)} when 'pincode' then {pin_error(x)} when 'dob' then {date_error(x)} else '' end end"


def over_fields(select: str, ctes: str = "") -> str:
    return f"with {FIELDS}{', ' + ctes if ctes else ''} {select}"


# -- correction ---------------------------------------------------------------------------------

for _query, _field, _rule in (("uid_correct", "uid", correct_digits("raw", 12)), ("pan_correct", "pan_number", correct_pan("raw")), ("pincode_correct", "pincode", correct_digits("raw", 6))):
    ORACLES[_query] = over_fields(f"select k, raw, {_rule} as corrected from fields where field_name = '{_field}'")

_ORDER = "strftime(o_orderdate, '%d/%m/%Y')"
ORACLES["date_correct"] = f"""
with raws as (select o_orderkey as k, case o_orderkey % 5 when 0 then translate({_ORDER}, '/', '-') when 1 then translate({_ORDER}, '/01', '.OI') when 2 then '4' || substr({_ORDER}, 2, 9)
  when 3 then 'on ' || {_ORDER} || ' x' else 'd' || right({_ORDER}, 4) || '/' end as raw from orders)
select k, raw, {correct_date('raw')} as corrected from raws"""

ORACLES["name_correct"] = f"""
with raws as (select p_partkey as k, case p_partkey % 3 when 0 then upper(p_name) when 1 then ' 0' || replace(p_name, ' ', '  1 ') || '. ' else p_name end as raw from part)
select k, raw, {correct_name('raw')} as corrected from raws"""

ORACLES["field_correct_dispatch"] = over_fields(
    "select id, ord, corrected, corrected <> raw as was_changed, case when corrected <> raw then field_name || ' correction applied' else '' end as change_description from fixed",
    f"fixed as (select id, ord, field_name, raw, {trimmed_field('field_name', 'raw')} as corrected from fields)",
)
ORACLES["substitution_rules"] = over_fields(f"select k, {digits('raw')} as digits, {letters('raw')} as letters, {mask('gt')} as masked, {mask('raw')} as masked_raw from fields where field_name = 'uid'")

# -- validation ---------------------------------------------------------------------------------

_PLAIN = "replace(uid, ' ', '')"
_SPOILED = "substr(uid, 1, 5) || ((substr(uid, 6, 1)::int + 1 + k % 9) % 10)::varchar || substr(uid, 7, 8)"
_ODD = f"case when k % 2 = 0 then uid else lower({re.sub(r'\bgt\b', 'uid', RAW)}) end"
ORACLES["uid_checksum_validate"] = f"""
with made as (select c_custkey as k from customer), u as (select k, {UID} as uid from made), s as (select k, uid, replace({_SPOILED}, ' ', '') as bad, {_ODD} as odd from u)
select k, uid, {verhoeff(_PLAIN, 0)} = 0 as good, {verhoeff('bad', 0)} = 0 as spoiled_good, {uid_error('odd')} as error from s"""

ORACLES["pan_validate"] = over_fields(f"select k, raw, {pan_error('raw')} as error, {pan_error('gt')} = '' as gt_valid from fields where field_name = 'pan_number'")

ORACLES["ifsc_validate_lookup"] = f"""
with codes as (select s_suppkey, [{values((*IFSC_CODES, 'ABCD0999999', ' hdfc0000009', 'HDFCO123456'))}][(s_suppkey % 7 + 1)::int] as ifsc from supplier),
e as (select s_suppkey, ifsc, case when not regexp_matches(upper({strip('ifsc')}), {text(v.IFSC_FORM)}) then {text(v.IFSC_ERROR)} when upper({strip('ifsc')}) not in ({values(IFSC_CODES)}) then {text(v.IFSC_UNKNOWN)} else '' end as error_message from codes)
select s_suppkey, ifsc, error_message = '' as is_valid, error_message from e"""

ORACLES["pincode_validate_lookup"] = over_fields("select k, raw, error_message = '' as is_valid, error_message from e", f"e as (select k, raw, {pin_error('raw')} as error_message from fields where field_name = 'pincode')")

_YEAR = "year(o_orderdate)"
ORACLES["date_validate"] = f"""
with d as (select o_orderkey as k, case o_orderkey % 8 when 0 then {_ORDER} when 1 then '31/04/' || {_YEAR}::varchar when 2 then left({_ORDER}, 6) || ({_YEAR} + 30)::varchar
  when 3 then left({_ORDER}, 6) || ({_YEAR} - 100)::varchar when 4 then ({_YEAR} - o_orderkey % 150)::varchar when 5 then ' 29/02/' || {_YEAR}::varchar
  when 6 then '01/06/' || (1900 + o_orderkey % 8 + o_orderkey % 30)::varchar else translate({_ORDER}, '/', '-') end as value from orders)
select k, value, {date_error('value')} as error from d"""

_RE2_PHONE = e.PHONE.replace(r"\s", r"[ \t\n\r\f\v]").replace(r"[0-9[ \t\n\r\f\v]\-]", r"[0-9 \t\n\r\f\v\-]")
ORACLES["email_phone_validate"] = f"""
with f as (select doc_id, regexp_extract(text, {text(e.EMAIL)}) as email, regexp_extract(text, {text(_RE2_PHONE)}) as phone from documents)
select doc_id, {form('trim(email)', v.EMAIL_FORM, 'x')} = '' as email_valid, {form('trim(phone)', v.PHONE_FORM, 'x')} = '' as phone_valid from f where email <> '' or phone <> ''"""

ORACLES["field_validate_dispatch"] = over_fields(
    "select id, ord, error_message = '' as is_valid, error_message from e",
    f"c as (select id, ord, field_name, case when k % 19 = 0 then '' else raw end as corrected from fields), e as (select id, ord, {field_error('field_name', 'corrected')} as error_message from c)",
)

# -- accuracy -----------------------------------------------------------------------------------

ORACLES["cer_per_field"] = over_fields(f"select id, ord, round({cer('raw', 'gt')}, 6) as cer from fields")
ORACLES["wer_per_field"] = f"""
with n as (select p_partkey as k, p_name, string_split(p_name, ' ') as w from part),
o as (select k, p_name, case k % 4 when 0 then array_to_string(list_reverse(w), ' ') when 1 then w[1] when 2 then p_name || ' ' || w[1] else '' end as other from n)
select k, round({wer('other', 'p_name')}, 6) as wer from o"""

_JOINED = "found as (select id, field_name, {value} as p from fields where present), judged as (select f.id, f.ord, f.field_name, f.gt as g, found.p, found.p is null as missing from fields f left join found using (id, field_name))"
_RATED = f"""rated as (select id, ord, field_name, not missing and {norm("coalesce(p, '')")} = {norm('g')} as exact_match,
  case when missing then 1.0 else {cer("coalesce(p, '')", 'g')} end as cer, case when missing then 1.0 else {wer("coalesce(p, '')", 'g')} end as wer,
  case when missing then '' else {norm('p')} end as pred, {norm('g')} as gt, missing from judged)"""
_FIXED = correct_field("field_name", "raw").replace("case field_name", "case field_name", 1)
_SUMMARY = """select field_name, n, exact_match_rate, mean_cer, mean_wer, missing_rate, case when exact_raw * 100 >= 97 then 'green' when exact_raw * 100 >= 85 then 'yellow' else 'red' end as band from (
  select field_name, count(*) as n, avg(exact_match::int) as exact_raw, round(avg(exact_match::int), 6) as exact_match_rate, round(avg(cer), 6) as mean_cer, round(avg(wer), 6) as mean_wer, round(avg(missing::int), 6) as missing_rate
  from rated group by field_name)"""
ORACLES["field_accuracy"] = over_fields("select id, ord, field_name, exact_match, round(cer, 6) as cer, round(wer, 6) as wer, pred, gt, missing from rated", f"{_JOINED.format(value='raw')}, {_RATED}")
ORACLES["field_accuracy_raw_summary"] = over_fields(_SUMMARY, f"{_JOINED.format(value='raw')}, {_RATED}")
ORACLES["field_accuracy_summary"] = over_fields(_SUMMARY, f"{_JOINED.format(value=trimmed_field('field_name', 'raw'))}, {_RATED}")

_DELTA = f"""pairs as (select id, ord, field_name, gt as g, case when present then raw else '' end as a, case when present then {trimmed_field('field_name', 'raw')} else '' end as b from fields),
rates as (select id, ord, field_name, {norm('a')} = {norm('g')} as pre_exact, {norm('b')} = {norm('g')} as post_exact, {cer('a', 'g')} as x, {cer('b', 'g')} as y from pairs),
delta as (select id, ord, field_name, pre_exact, post_exact, round(x, 4) as pre_cer, round(y, 4) as post_cer, round(y - x, 4) as cer_delta, y - x < -1e-9 as improved, y - x > 1e-9 as degraded, abs(y - x) < 1e-9 as unchanged from rates)"""
_GAIN = """gain as (select field_name, count(*) as n, round(avg(pre_exact::int), 4) as pre_exact_rate, round(avg(post_exact::int), 4) as post_exact_rate,
  round(avg(post_exact::int) - avg(pre_exact::int), 4) as exact_delta, round(avg(cer_delta), 4) as mean_cer_delta, round(avg(improved::int), 4) as improved_rate, round(avg(degraded::int), 4) as degraded_rate from delta group by field_name)"""
ORACLES["correction_delta"] = over_fields("select * from delta", _DELTA)
ORACLES["correction_delta_summary"] = over_fields("select *, case when exact_delta * 100 > 0.5 then '▲' when exact_delta * 100 < -0.5 then '▼' else ' ' end as arrow from gain", f"{_DELTA}, {_GAIN}")
_NUMBERED = "numbered as (select id, ord, field_name, case when field_name = 'name' and k % 3 = 0 then gt || ' ' || (k % 10)::varchar else gt end as gt from fields)"
_KEPT = _DELTA.replace("case when present then raw else '' end", "gt").replace(f"case when present then {trimmed_field('field_name', 'raw')} else '' end", trimmed_field("field_name", "gt")).replace("from fields)", "from numbered)")
ORACLES["correction_regressions"] = over_fields("select field_name, degraded_rate from gain where degraded_rate > 0.01", f"{_NUMBERED}, {_KEPT}, {_GAIN}")
ORACLES["global_error_rates"] = over_fields(
    f"select count(*) as n, round(avg({cer('p', 'g')}), 6) as mean_cer, round(avg({wer('p', 'g')}), 6) as mean_wer from q",
    "q as (select gt as g, case when present then raw else '' end as p from fields)",
)

_ALIGNED = """aligned as (select pred, gt, count(*) as n from (
  select substr(raw, i::int, 1) as pred, substr(gt, i::int, 1) as gt from (select raw, gt, unnest(range(1, length(raw) + 1)) as i from fields where length(raw) = length(gt) and length(raw) > 0))
  where pred <> gt group by pred, gt)"""
ORACLES["confusion_pairs_aligned"] = over_fields("select * from aligned", _ALIGNED)
# the library's script: common ends off, then from the last characters on drop, add, or keep and replace; i and j count what is left of p and g
_FAR = "levenshtein(left(p, {i}), left(g, {j}))"
_DROP = f"{_FAR.format(i='i', j='j')} = {_FAR.format(i='i - 1', j='j')} + 1"
_ADD = f"j > 1 and {_FAR.format(i='i', j='j - 1')} = {_FAR.format(i='i - 1', j='j - 1')} - 1"
ORACLES["confusion_pairs_editops"] = over_fields(
    "select a as pred, b as gt, sum(times)::bigint as n from steps where a is not null group by a, b",
    f"""texts as (select {norm('raw')} as p, {norm('gt')} as g, count(*) as times from fields group by 1, 2),
ends as (select p, g, times, coalesce(list_max(list_filter(range(1, least(length(p), length(g)) + 1), lambda n: left(p, n::int) = left(g, n::int))), 0)::int as a from texts where p <> g),
more as (select *, coalesce(list_max(list_filter(range(1, least(length(p), length(g)) - a + 1), lambda n: right(p, n::int) = right(g, n::int))), 0)::int as b from ends),
cut as (select substr(p, a + 1, length(p) - a - b) as p, substr(g, a + 1, length(g) - a - b) as g, times from more),
steps as (with recursive walk as (
  select p, g, times, length(p)::int as i, length(g)::int as j, null::varchar as a, null::varchar as b from cut
  union all
  select p, g, times, case when {_DROP} then i - 1 when {_ADD} then i else i - 1 end::int, case when {_DROP} then j else j - 1 end::int,
    case when not ({_DROP}) and not ({_ADD}) and substr(p, i, 1) <> substr(g, j, 1) then substr(p, i, 1) end, case when not ({_DROP}) and not ({_ADD}) and substr(p, i, 1) <> substr(g, j, 1) then substr(g, j, 1) end
  from walk where i > 0 and j > 0) select * from walk)""",
)
ORACLES["top_confusions"] = over_fields("select pred, gt, n, repeat('█', floor(n / max(n) over () * 30)::int) as bar from top", f"{_ALIGNED}, top as (select * from aligned order by n desc, pred, gt limit 20)")

_IDS = "g as (select distinct id from fields), p as (select distinct id from fields where present union select 'x' || k::varchar from fields where k % 17 = 0)"
ORACLES["eval_matched"] = over_fields("select id from g intersect select id from p", _IDS)
ORACLES["eval_unmatched_pred"] = over_fields("select id from p except select id from g", _IDS)
ORACLES["eval_unmatched_gt"] = over_fields("select id from g except select id from p", _IDS)
ORACLES["dedupe_last_by_id"] = "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1"

# -- routing and responses ------------------------------------------------------------------------

_ROUTED = f"""
f1 as (select k, id, ord, field_name, raw, conf, k % 9 <> 0 as has_deps, k % 7 <> 0 as tall, case when k % 2 = 1 then raw else gt end as retry_raw, (17 * k % 100) / 100.0::double as retry_conf,
  case k % 3 when 0 then 'aadhaar' when 1 then 'pan' else 'other' end as doc_type from fields where present),
f2 as materialized (select *, {trimmed_field('field_name', 'raw')} as corrected, {trimmed_field('field_name', 'retry_raw')} as retry_corrected from f1),
f3 as materialized (select *, corrected <> raw as changed, retry_corrected <> retry_raw as retry_changed, {field_error('field_name', 'corrected')} as error_message, {field_error('field_name', 'retry_corrected')} = '' as again from f2),
f4 as (select *, error_message = '' as is_valid from f3),
f5 as materialized (select *, case when changed and is_valid and (field_name in ('uid', 'aadhaar_number', 'pan_number') or conf >= 0.7) then 1 when conf >= 0.92 and is_valid then 1 when conf >= 0.92 then 2
  when not has_deps then 3 when conf >= 0.7 and is_valid then 1 when conf >= 0.7 and tall and again then 4 when conf >= 0.7 then 5 when again then 4 else 6 end as way from f4),
routed as (select id, ord, field_name, doc_type, is_valid, error_message,
  case when way in (4, 6) then retry_corrected else corrected end as value, case when way in (4, 6) then retry_conf else conf end as confidence,
  case when way in (1, 4) then 'accept' when way in (2, 5) then 'escalate' else 'flag' end as status,
  case way when 2 then 'high_conf_validation_fail' when 3 then 'missing_retry_deps' when 5 then 'medium_conf_validation_fail' when 6 then 'low_conf_validation_fail' end as flag_reason,
  case when way in (4, 6) then retry_raw else raw end as raw_ocr_value, case when way in (4, 6) then retry_changed else changed end as was_corrected,
  (case when way in (4, 6) or (way = 5 and tall) then 2 else 1 end)::int as attempts from f5)"""
ORACLES["route_decisions"] = over_fields("select id, ord, value, confidence, status, flag_reason, raw_ocr_value, was_corrected, attempts from routed", _ROUTED)
ORACLES["routing_status_summary"] = over_fields("select status, flag_reason, field_name, count(*) as n, round(avg(confidence), 6) as confidence from routed where status <> 'accept' group by all", _ROUTED)
ORACLES["response_rollup"] = over_fields(
    """select id, doc_type, count(*) as n_fields, sum(was_corrected::int)::bigint as correction_count, sum((status = 'escalate')::int)::bigint as escalation_count, sum((status <> 'accept')::int)::bigint as flag_count,
    round(avg(confidence), 6) as overall_confidence, bool_and(is_valid) as all_fields_valid, arg_max(is_valid, ord) filter (field_name in ('uid', 'pan_number')) as checksum_passed from routed group by id, doc_type""",
    _ROUTED,
)
ORACLES["response_flags"] = over_fields("select id, field_name, flag_reason, raw_ocr_value, value as corrected_value, confidence from routed where status <> 'accept'", _ROUTED)
_SHOWN = " or ".join(f"(doc_type = '{kind}' and field_name in ({values(names)}))" for kind, names in r.SHOWN.items())
ORACLES["response_fields"] = over_fields(
    f"select id, doc_type, field_name as shown, case when field_name = 'uid' then {mask('value')} else value end as value, case when field_name = 'uid' then {mask('raw_ocr_value')} else raw_ocr_value end as raw_ocr_value, status from routed where doc_type = 'other' or {_SHOWN}",
    _ROUTED,
)

# -- documents ------------------------------------------------------------------------------------

_LINES = r"string_split_regex({x}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def lines(x: str) -> str:
    return _LINES.format(x=x)


ORACLES["pdf_text_route"] = rf"""
with c as (select doc_id, length({strip('text')}) >= 100 as min_chars, length(regexp_replace(text, '[^\x09-\x0D\x20-\x7E]', '', 'g'))::double / greatest(length(text), 1) >= 0.85 as printable_ratio,
  len(list_filter({lines('text')}, lambda l: len(regexp_extract_all(l, '[^\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+')) >= 4)) >= 3 as min_text_lines from documents)
select doc_id, min_chars, printable_ratio, min_text_lines, round((min_chars::int + printable_ratio::int + min_text_lines::int) / 3.0, 6) as score,
  case when min_chars and printable_ratio and min_text_lines then 'text' else 'image' end as route,
  case when min_chars and printable_ratio and min_text_lines then 'all_checks_passed' else 'failed_checks: [' || array_to_string(list_filter([case when not min_chars then '''min_chars''' end, case when not printable_ratio then '''printable_ratio''' end,
    case when not min_text_lines then '''min_text_lines''' end], lambda x: x is not null), ', ') || ']' end as reason from c"""


def lined(*parts: str) -> str:
    """Parts that aren't null, joined by line feeds."""
    return f"concat_ws(chr(10), {', '.join(parts)})"


_CV = lined(
    "case when p_partkey % 7 <> 0 then '  ' || " + title("p_name") + " else '' end", "case when p_partkey % 3 <> 0 then 'Senior ' || ['Engineer', 'Data Analyst', 'Clerk'][(1 + p_partkey % 3)::int] end",
    "case when p_partkey % 5 <> 0 then 'mail: user' || p_partkey::varchar || '@example.com' end", "case when p_partkey % 4 <> 0 then '+91 98765 ' || lpad((p_partkey % 100000)::varchar, 5, '0') end",
    "case when p_partkey % 6 = 1 then 'https://www.LinkedIn.com/in/user-x_1' end", "'Technical Skills and tools'", "p_brand || ', SQL | ' || p_type", "case when p_partkey % 2 = 0 then 'skills more' end",
    "case when p_partkey % 2 = 0 then 'Spark,, Python |' end", "'EXPERIENCE'", "case when p_partkey % 3 = 0 then 'Jan 2015 - Mar 2019' end", "case when p_partkey % 3 <> 1 then 'April 2019 - present' end",
    "case when p_partkey % 8 <> 0 then 'Education' end", "case when p_partkey % 8 = 2 then 'education again' end", "'BSc ' || p_name",
)
_CARD1 = lined("'Government of India'", "'Name: ' || p_name", f"'DOB : ' || {DOB}", "case when k % 3 = 0 then 'Gender: Female' end", f"case when k % 5 <> 0 then {UID} end")
_CARD2 = lined(
    "'INCOME TAX DEPARTMENT'", "'Name'", title("p_name"), "case when k % 2 = 0 then 'Father''s Name' end", "'Old ' || p_name", "case when k % 3 = 0 then 'NAME again' end", "'Date of Birth'", DOB, f"case when k % 7 <> 0 then {PAN} end"
)
CARDS = f"cards as (select k, case when k % 2 = 0 then 'aadhaar' else 'pan' end as doc_type, case when k % 2 = 0 then {_CARD1} else {_CARD2} end as text from (select c_custkey as k, p_name from customer join part on p_partkey = c_custkey))"
CVS = f"cvs as (select p_partkey as id, {_CV} as text from part)"


def text_type(x: str) -> str:
    low = f"lower({x})"
    return f"""case when contains({low}, 'experience') and (contains({low}, 'skills') or contains({low}, 'education')) then 'cv' when regexp_matches({low}, '[a-z]{{5}}[0-9]{{4}}[a-z]') or contains({low}, 'income tax department') then 'pan'
      when contains({low}, 'aadhaar') or contains({low}, 'unique identification') then 'aadhaar' else 'unknown' end"""


ORACLES["doc_classify"] = f"""with {CARDS}, {CVS}, texts as (select 'd' || doc_id::varchar as id, text from documents union all select 'p' || page_id::varchar, html from pages union all select 'k' || k::varchar, text from cards
  union all select 'v' || id::varchar, text from cvs) select id, {text_type('text')} as doc_type from texts"""


def found_in(table: str, key: str, column: str, pattern: str) -> str:
    return f"with f as (select {key}, regexp_extract({column}, {text(pattern)}) as found from {table}) select {key}, coalesce(found, '') as found from f"


ORACLES["extract_email"] = found_in("documents", "doc_id", "text", e.EMAIL)
ORACLES["extract_phone"] = found_in("documents", "doc_id", "text", _RE2_PHONE)
ORACLES["extract_phone_pages"] = found_in("pages", "page_id", "html", _RE2_PHONE)
ORACLES["extract_uid_like"] = f"with {CARDS} select k, regexp_extract(text, {text(e.UID)}) as found from cards"

# lines of a CV, numbered; the first skills header opens the block, the next section closes it
_CV_PARTS = r"""
own as (select id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') as l from cvs),
marks as (select id, text, l, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^(skills|technical skills)')), true) as s, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^education')), true) as d from own),
cut as (select *, list_position(list_transform(l[s + 1:], lambda x: regexp_matches(x, '(?i)^(experience|education|projects|work history)')), true) as stop from marks),
got as (select id, text, coalesce(l[1], '') as name, coalesce(list_filter(l[1:10], lambda x: regexp_matches(x, '(?i)\b(engineer|manager|developer|designer|analyst|consultant)\b'))[1], '') as current_title,
  array_to_string(list_filter(list_transform(regexp_split_to_array(array_to_string(list_filter(l[s + 1:s + stop - 1], lambda x: not regexp_matches(x, '(?i)^(skills|technical skills)')), ' '), '[,|]'), lambda x: trim(x)), lambda x: x <> ''), ', ') as skills,
  case when d > 0 then coalesce(list_filter(l[d:], lambda x: not regexp_matches(x, '(?i)^education'))[1], '') else '' end as education from cut),
"""
_RE2_RANGE = e.RANGE
_CV_FOUND = f"""wide as (select id, name, regexp_extract(text, {text(e.EMAIL)}) as email, regexp_extract(text, {text(_RE2_PHONE)}) as phone, regexp_extract(text, '(?i)linkedin\\.com/in/[\\pL\\pN_\\-]+') as linkedin,
  len(regexp_extract_all(text, {text(_RE2_RANGE)}))::varchar as total_experience_years, current_title, skills, education from got)"""
_LACKS = ", ".join(f"case when {f} = '{0 if f == 'total_experience_years' else ''}' then '{f} missing' end" for f in e.CV_FIELDS)
ORACLES["extract_cv_sections"] = f"with {CVS},{_CV_PARTS}{_CV_FOUND} select *, concat_ws(';', {_LACKS}) as warnings from wide"
_CV_LONG = " union all ".join(f"select id, '{f}' as field_name, {f} as value from wide" for f in e.CV_FIELDS)
ORACLES["text_layer_decisions"] = f"""with {CVS}, kept as (select * from cvs where length({strip('text')}) >= 100 and len(list_filter(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '\\S+')) >= 4)) >= 3),
{CVS.replace('cvs as', 'unused as')},{_CV_PARTS.replace('from cvs', 'from kept')}{_CV_FOUND}, long as ({_CV_LONG}),
judged as (select id, field_name, value, value <> '' and case field_name when 'email' then regexp_matches(trim(value), {text(v.EMAIL_FORM)}) when 'phone' then regexp_matches(trim(value), {text(v.PHONE_FORM)}) else true end as ok from long)
select id, 'cv' as doc_type, field_name, value, case when ok then 'accept' else 'flag' end as status, case when not ok then 'validation_failed_text_layer' end as flag_reason from judged"""

ORACLES["extract_card_labels"] = rf"""with {CARDS} select k, trim(regexp_extract(text, '(?i)(?:name|नाम)\s*[:\-]?\s*(.+)', 1)) as name, regexp_extract(text, '(?i)(?:dob|date of birth)\s*[:\-]?\s*([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', 1) as dob,
  regexp_extract(text, '(?i)(?:gender|लिंग)\s*[:\-]?\s*(male|female|transgender)', 1) as gender, regexp_extract(text, {text(e.UID)}) as uid from cards where doc_type = 'aadhaar'"""
_LABEL = "case when contains(lower(line), 'name') and not contains(lower(line), 'father') then 'name' when contains(lower(line), 'father') then 'father_name' when contains(lower(line), 'date of birth') or contains(lower(line), 'dob') then 'dob' end"
ORACLES["extract_label_proximity"] = f"""with {CARDS}, own as (select k, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') as l from cards where doc_type = 'pan'),
numbered as (select k, l, unnest(l) as line, generate_subscripts(l, 1) as i from own), labelled as (select k, i, {_LABEL} as label, l[i + 1] as value from numbered where i < len(l)),
last as (select k, label, arg_max(value, i) as value from labelled where label is not null group by k, label),
wide as (select own.k, regexp_extract(text, {text(e.PAN)}) as pan_number, coalesce(a.value, '') as name, coalesce(b.value, '') as father_name, coalesce(c.value, '') as dob from own
  left join last a on a.k = own.k and a.label = 'name' left join last b on b.k = own.k and b.label = 'father_name' left join last c on c.k = own.k and c.label = 'dob')
select *, concat_ws(';', case when pan_number = '' then 'pan_number missing' end, case when name = '' then 'name missing' end, case when father_name = '' then 'father_name missing' end, case when dob = '' then 'dob missing' end) as warnings from wide"""

ORACLES["first_pages_text"] = "select conv_id as doc_id, coalesce(string_agg(text, chr(10) order by turn) filter (turn < 3 and text <> ''), '') as text, count(turn) as page_count from conversations group by conv_id"

_ASPECT = "(w::double / greatest(h, 1))"
ORACLES["template_cascade"] = f"""
with d as (select p_partkey as k, 300 + 37 * p_partkey % 900 as w, 300 + 53 * p_partkey % 700 as h, case when p_partkey % 29 = 0 then 'x ABCPD1234F' when p_partkey % 31 = 0 then '1234 56789012' else p_name end as text,
  (7 * p_partkey % 11) / 100.0::double as blue, (11 * p_partkey % 23) / 100.0::double as cream, (13 * p_partkey % 29) / 100.0::double as white, p_partkey % 3 = 0 as qr from part),
m as (select k, case when regexp_matches(text, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') then 'pan/pan_v2/0.99/text_regex_pan' when regexp_matches(text, '[0-9]{{4}}\\s?[0-9]{{4}}\\s?[0-9]{{4}}') then 'aadhaar/aadhaar_v3/0.99/text_regex_aadhaar'
  when abs({_ASPECT} - 0.63) < 0.15 then 'aadhaar/aadhaar_v4/0.9/aspect_ratio_portrait' when {_ASPECT} between 0.65 and 0.85 then 'cv/cv_standard/0.8/aspect_ratio_a4'
  when not ({_ASPECT} > 1.4 and {_ASPECT} < 1.7) then 'unknown/unknown/0.0/aspect_ratio_out_of_bounds' when blue > 0.05 and qr then 'aadhaar/aadhaar_v2/0.8/hsv_blue_with_qr' when blue > 0.05 then 'aadhaar/aadhaar_v1/0.7/hsv_blue_no_qr'
  when cream > 0.1 then 'pan/pan_v1/0.7/hsv_cream' when white > 0.1 and qr then 'aadhaar/aadhaar_v3/0.8/hsv_white_with_qr' when white > 0.1 then 'pan/pan_v2/0.7/hsv_white_no_qr' else 'aadhaar/aadhaar_v3/0.2/absolute_fallback_guess' end as x from d)
select k, split_part(x, '/', 1) as doc_type, split_part(x, '/', 2) as template_version, split_part(x, '/', 3)::double as confidence, split_part(x, '/', 4) as detection_method from m"""

ORACLES["ingest_checks"] = """
with c as (select p_partkey as k, ['FFD8FFE0', '89504E470D0A1A0A', '255044462D', 'FFD8', '424D', '2550'][(1 + p_partkey % 6)::int] as head,
  p_name || repeat('x', (p_partkey % 40)::int) || case p_partkey % 4 when 0 then '%%EOF' when 1 then '%%Eof' || chr(10) else '' end as tail from part),
b as (select k, head, tail, head || hex(tail) as h from c),
m as (select k, tail, h, length(h) // 2 as size, case when starts_with(h, 'FFD8FF') then 'image/jpeg' when starts_with(h, '89504E470D0A1A0A') then 'image/png' when starts_with(h, '25504446') then 'application/pdf' when starts_with(h, 'FFD8') then 'image/jpeg' end as kind from b)
select k, case when size <= 40 then kind end as mime, case when size > 40 then 'file_size' when kind is null then 'unsupported_format' when kind = 'application/pdf' and not (contains(tail, '%%EOF') or contains(tail, '%%Eof')) or starts_with(kind, 'image/') then 'corrupt_file' end as reject_reason,
  size::bigint as size, lower(left(h, 16)) as magic from m"""

# -- regions and vectors --------------------------------------------------------------------------

ORD = "l_linenumber * 1000000000::bigint + l_partkey * 1000 + l_suppkey % 1000"
REGIONS = f"""regions as (select l_orderkey as doc_id, {ORD} as ord, p_name as text, (l_partkey % 100) / 100.0::double as confidence, 7 * l_suppkey % 900 as x, 40 * l_linenumber + l_partkey % 9 as y
  from lineitem join part on p_partkey = l_partkey), placed as (select *, x + 50.0::double as cx, y + 15.0::double as cy from regions)"""


def read_in_order(keys: str, source: str) -> str:
    return f"select {keys}, string_agg(text, ' ' order by cy, cx, ord, text) as text, round(sum(confidence * length(text)) / sum(length(text)) + 1e-9, 6) as confidence from {source} group by {keys}"


def box_rows(version: str) -> str:
    return "boxes(field_name, x1, y1, x2, y2) as (values " + ", ".join(f"('{f}', {', '.join(map(str, b))})" for f, b in BOXES[version].items()) + ")"


_INSIDE = "cx >= greatest(x1, 0) and cx < least(x2, 1012) and cy >= greatest(y1{d}, 0) and cy < least(y2{d}, 638)"
ORACLES["reading_order_text"] = f"with {REGIONS} {read_in_order('doc_id', 'placed')}"
ORACLES["coord_field_assign"] = f"with {REGIONS}, {box_rows('pan_v2')}, hits as (select * from placed, boxes where {_INSIDE.format(d='')}) {read_in_order('doc_id, field_name', 'hits')}"
_HEADED = REGIONS.replace("p_name as text", f"case when (l_orderkey + {ORD}) % 5 = 0 then 'Govt of India ' || p_name else p_name end as text")
_SHIFTS = "shifts as (select doc_id, trunc(arg_min(cy, ord) - 50)::int as dy from placed where contains(upper(text), 'GOVERNMENT') or contains(upper(text), 'INDIA') group by doc_id)"
ORACLES["anchor_shift"] = f"with {_HEADED}, {_SHIFTS} select doc_id, dy from shifts"
ORACLES["registered_fields"] = f"""with {_HEADED}, {_SHIFTS}, {box_rows('aadhaar_v3')}, first as (select * from placed, boxes where {_INSIDE.format(d='')}),
missed as (select doc_id from (select distinct doc_id from placed) except select doc_id from first where field_name = 'aadhaar_number'), moved as (select * from shifts where doc_id in (select doc_id from missed)),
hits as (select * exclude (dy) from (select placed.*, boxes.*, dy from placed join moved using (doc_id), boxes where {_INSIDE.format(d=' + dy')}) union all select * from first where doc_id not in (select doc_id from moved))
{read_in_order('doc_id, field_name', 'hits')}"""
_THIRD = "anchors as (select doc_id, arg_min(cx, ord) as ax, arg_min(cy, ord) as ay from placed where ord >= 3000000000 group by doc_id)"
_HEADERS = " or ".join(f"contains(upper(text), '{w}')" for w in sp.HEADER_WORDS)
ORACLES["nearest_above"] = f"with {REGIONS}, {_THIRD} select doc_id, text as name from placed join anchors using (doc_id) where cy < ay - 10 and not ({_HEADERS}) qualify row_number() over (partition by doc_id order by cy desc, ord) = 1"
_PRINTED = " or ".join(f"contains(upper(text), '{w}')" for w in sp.BOILERPLATE)
ORACLES["nearest_two"] = f"""with {REGIONS}, {_THIRD}, near as (select doc_id, ord, text, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) as dist from placed join anchors using (doc_id)
  where not ({_PRINTED}) and not (contains(upper(text), 'FATHER') and contains(upper(text), 'NAME')) and not (contains(upper(text), 'NAME') and length(regexp_replace(upper(text), '[^A-Z]', '', 'g')) <= 8) and length(text) >= 3),
ranked as (select *, row_number() over (partition by doc_id order by dist, ord) as n from near)
select doc_id, max(text) filter (n = 1) as father_name, max(text) filter (n = 2) as name from ranked group by doc_id"""
ORACLES["region_hull"] = f"with {REGIONS} select doc_id, greatest(0, min(x) - 5)::int as x1, greatest(0, min(y) - 5)::int as y1, least(1012, max(x) + 105)::int as x2, least(638, max(y) + 35)::int as y2 from regions group by doc_id"
_RE2_ADDRESS = r"(?i)(?:Address|पता)\s*[:;-]?\s*(.*?(?:[^0-9\n]))([1-8][0-9]{5})(?:[^0-9]|$)"
ORACLES["card_text_fields"] = rf"""with {CARDS}, joined as (select k, replace(text, chr(10), ' ') || ' Address: 12 Some Road ' || (case when k % 3 = 0 then '1234567 ' else '' end) || {PIN} as text from cards where doc_type = 'aadhaar'),
u as (select k, text, regexp_extract(text, '([0-9]{{4}}\s?[0-9]{{4}}\s?[0-9]{{4}})', 1) as number from joined), rest as (select k, number, case when number = '' then text else replace(text, number, '') end as text from u)
select k, replace(number, ' ', '') as aadhaar_number, regexp_extract(text, '(?i)(?:DOB|D0B|YOB|Birth).*?([0-9]{{2}}[/-][0-9]{{2}}[/-][0-9]{{4}}|[0-9]{{4}})', 1) as dob,
  {title("replace(regexp_extract(text, '(?i)(MALE|FEMALE|TRANSGENDER|M a l e|F e m a l e)', 1), ' ', '')")} as gender,
  trim(regexp_extract(text, {text(_RE2_ADDRESS)}, 1) || regexp_extract(text, {text(_RE2_ADDRESS)}, 2)) as address, regexp_extract(text, {text(_RE2_ADDRESS)}, 2) as pincode from rest"""

_MATCHES = """own as (select vec_id, embedding::double[] as e from embeddings), stored as (select vec_id as key, e from own where (vec_id % 20 + 81) / 100.0 >= 0.95),
sims as (select q.vec_id as query_id, key, list_inner_product(q.e, s.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(s.e, s.e))) as s from own q, stored s where q.vec_id <> key),
best as (select query_id, key, s, s >= 0.4 as hit from sims qualify row_number() over (partition by query_id order by round(s, 12) desc, key) = 1)"""
ORACLES["glyph_best_match"] = f"with {_MATCHES} select query_id, key, round(s, 4) as similarity, hit from best"
ORACLES["glyph_cache_stats"] = f"with {_MATCHES} select count(*) filter (hit) as cache_hits, count(*) filter (not hit) as cache_misses, round(avg(hit::int), 6) as hit_rate from best"

# -- feedback -------------------------------------------------------------------------------------

ORACLES["feedback_pending_push"] = "select event_id as id, ts, event_id + 10000 as task_id from events where user_id % 2 <> 0 and user_id % 3 <> 0 and ts < timestamp '2024-01-19 23:00:00'"
ORACLES["feedback_latest_state"] = """with s as (select user_id as id, date_trunc('day', ts)::timestamp as ts, event_id % 3 as step from events)
select id, ts, (['new', 'pushed', 'corrected'])[(step + 1)::int] as state from s qualify row_number() over (partition by id order by ts desc, step desc) = 1"""
ORACLES["feedback_apply_corrections"] = """select event_id as id, user_id % 2 = 0 as pushed, user_id % 3 = 0 or (event_id % 2 = 0 and user_id % 2 = 0) as corrected,
  case when event_id % 2 = 0 and user_id % 2 = 0 and user_id % 3 <> 0 then event_id::varchar || '_FIXED' end as human_value from events"""
ORACLES["suggested_subs"] = over_fields(
    "select kind, pred as raw_char, gt as human_char, n from kinds where kind is not null qualify row_number() over (partition by kind, pred order by n, gt desc) = 1",
    _ALIGNED + ", kinds as (select *, case when regexp_matches(gt, '[0-9]') then 'digit' when regexp_matches(gt, '[a-zA-Z]') then 'alpha' end as kind from aligned where n >= 3)",
)
ORACLES["annotation_flatten"] = """select 'cards/' || l_orderkey::varchar || '.jpg' as image_path, 'field' || (l_linenumber % 4)::varchar as field_name, round(l_quantity / 100, 6) as x, 0.05::double as h, l_returnflag as text_value, 'ocr' as extraction_method
from lineitem where l_linenumber % 6 <> 0"""

# -- images ---------------------------------------------------------------------------------------

_POINTS = "[[100 + 3 * k % 50, 250 + 7 * k % 40], [400 + 11 * k % 60, 50 + 5 * k % 30], [100 + 13 * k % 70, 50 + 17 * k % 20], [400 + 19 * k % 90, 250 + 23 * k % 80]]"
_CORNERS = ", ".join(f"list_sort(list_transform(p, lambda a: [{order}] || a))[1] as {name}" for name, order in (("tl", "a[1] + a[2]"), ("tr", "a[2] - a[1]"), ("br", "-a[1] - a[2]"), ("bl", "a[1] - a[2]")))
_EDGE = "sqrt((({a})[2] - ({b})[2]) ** 2 + (({a})[3] - ({b})[3]) ** 2)"
ORACLES["corner_order"] = f"""with p as (select k, {_POINTS} as p from (select p_partkey as k from part)), c as (select k, {_CORNERS} from p)
select k, tl[2]::double as tl_x, tl[3]::double as tl_y, tr[2]::double as tr_x, tr[3]::double as tr_y, br[2]::double as br_x, br[3]::double as br_y, bl[2]::double as bl_x, bl[3]::double as bl_y,
  trunc(greatest({_EDGE.format(a='tl', b='tr')}, {_EDGE.format(a='bl', b='br')}))::int as width, trunc(greatest({_EDGE.format(a='tl', b='bl')}, {_EDGE.format(a='tr', b='br')}))::int as height from c"""
ORACLES["deskew_angle"] = """with s as (select l_orderkey as image_id, 100 * (l_linenumber % 3) as dx, l_suppkey % 5 - 2 + case when l_linenumber = 4 then 300 else 0 end as dy from lineitem),
a as (select image_id, degrees(atan2(dy, dx)) as angle from s where dx <> 0), m as (select image_id, median(angle) as angle from a where abs(angle) < 45 group by image_id)
select image_id, round(angle, 6) as angle, abs(angle) >= 0.5 as turn from m"""
ORACLES["letterbox_geometry"] = """with s as (select p_partkey as k, case when p_partkey % 50 = 0 then 1012 else 100 + 37 * p_partkey % 3000 end as w, case when p_partkey % 50 = 0 then 638 else 100 + 53 * p_partkey % 2000 end as h from part),
n as (select k, w, h, round_even(w * least(1012.0::double / w, 638.0::double / h), 0)::int as new_w, round_even(h * least(1012.0::double / w, 638.0::double / h), 0)::int as new_h from s)
select k, w = 1012 and h = 638 as same, new_w, new_h, floor((1012 - new_w) / 2)::int as x_off, floor((638 - new_h) / 2)::int as y_off from n"""
ORACLES["image_decisions"] = "select p_partkey as k, not (p_partkey * 7 % 256 between 100 and 200) as contrast, (p_partkey % 50) / 1000.0::double > 0.02 as glare from part"
_COINS = ", ".join(f"case when (seed * {2 * i + 3} + {i * 613}) % 9973 % 100 < 50 then '{name}' end" for i, name in enumerate(AUGMENTATIONS))
ORACLES["augment_plan"] = f"""with v as (select doc_id, unnest([1, 2, 3])::int as variant from documents), s as (select doc_id, variant, (doc_id * 7919 + variant * 104729) % 1000003 as seed from v)
select doc_id, variant, concat_ws(',', {_COINS}) as applied from s"""
ORACLES["synthetic_cards"] = f"""with made as (select c_custkey as k from customer), m as (select k, {UID} as uid, {PAN} as pan, {DOB} as dob from made)
select k, uid, pan, dob, {uid_error('uid')} = '' as uid_valid, {pan_error('pan')} = '' as pan_valid from m"""

ORACLES["image_integrity"] = "select p_partkey as k, 'image/png' as mime, case when p_partkey % 5 <> 0 then 'corrupt_file' end as reject_reason from part"
ORACLES["letterbox_pixels"] = """with s as (select s_suppkey::bigint as image_id, 20 + 37 * s_suppkey % 300 as w, 20 + 53 * s_suppkey % 200 as h from supplier),
n as (select image_id, round_even(w * least(1012.0::double / w, 638.0::double / h), 0)::bigint * round_even(h * least(1012.0::double / w, 638.0::double / h), 0)::bigint as inside from s) select image_id, inside, 1012 * 638 - inside as frame from n"""
ORACLES["warped_cards"] = "select s_suppkey::bigint as image_id, (40 + 7 * s_suppkey % 60)::int as width, (30 + 5 * s_suppkey % 40)::int as height, true as whole from supplier"
ORACLES["found_boundaries"] = "select n_nationkey::bigint as image_id, n_nationkey % 5 <> 0 as found, n_nationkey % 5 <> 0 as near from nation"
ORACLES["clean_up_pixels"] = """with s as (select n_nationkey::bigint as image_id, 20 + 8 * n_nationkey % 200 as v, case when n_nationkey % 2 = 1 then 300 * 400 / (638.0 * 1012) else 0 end as patch from nation)
select image_id, concat_ws(',', case when v * (1 - patch) + 255 * patch not between 100 and 200 then 'clahe' end, case when patch > 0 then 'glare_removal' end) as steps, false as bright from s"""
ORACLES["second_views"] = """with s as (select s_suppkey::bigint as id, 31 * s_suppkey % 100 / 100.0::double as conf, s_suppkey % 3 = 0 as valid, 10 + s_suppkey % 12 as h, 10 + s_suppkey % 17 as w from supplier),
v as (select *, case when conf < 0.7 then 'sharpened' when conf < 0.92 and not valid and h > 15 and w > 15 then 'inset' end as view from s), c as (select id, view, h - case view when 'inset' then 10 else 0 end as h, w - case view when 'inset' then 10 else 0 end as w from v)
select id, view, h::int as h, w::int as w, (h * w * 3)::int as size from c where view is not null"""
ORACLES["sharpened_spots"] = "with s as (select s_suppkey::bigint as image_id, 50 + 7 * s_suppkey % 150 as v from supplier) select image_id, least(255, v + 100)::int as spot, (v - 20)::int as beside, v::int as flat from s"
ORACLES["template_colours"] = """with s as (select s_suppkey::bigint as image_id, s_suppkey % 4 as kind, (1 + s_suppkey % 40) / 40.0::double as share from supplier)
select image_id, case when kind = 0 then round(share, 6) else 0.0 end as blue, case when kind = 1 then round(share, 6) else 0.0 end as cream, case when kind in (1, 2) then round(share, 6) else 0.0 end as white,
  round(share * ([0.114 * 255 + 0.587 * 200 + 0.299 * 150, 0.114 * 225 + 0.587 * 245 + 0.299 * 255, 255.0, 0.0]::double[])[kind + 1], 6) as mean_luminance from s"""
ORACLES["qr_presence"] = "select n_nationkey::bigint as image_id, n_nationkey % 3 = 0 as has_qr from nation"
ORACLES["glyph_descriptors"] = """select s_suppkey::bigint as image_id, 1568::int as size, (case when s_suppkey % 4 = 3 then 0 else 196 end)::int as lit, case s_suppkey % 4 when 0 then 0 when 1 then 4 when 2 then 2 end::int as way,
  case when s_suppkey % 4 = 3 then 0.0 else 4.0 end::double as strength from supplier"""
ORACLES["augmented_pictures"] = f"""with v as (select n_nationkey::bigint as image_id, unnest([1, 2, 3])::int as variant from nation), s as (select image_id, variant, (image_id * 7919 + variant * 104729) % 1000003 as seed from v)
select image_id, variant, concat_ws(',', {_COINS}) as applied, concat_ws(',', {_COINS}) as logged, (90 * 130 * 3)::int as size from s"""

# -- files and streams ----------------------------------------------------------------------------

ORACLES["documents_read"] = """with d as (select r_regionkey::int as k, (['%PDF-1.7 ', 'plain text ', '%PDF-'])[r_regionkey % 3 + 1] || r_name || repeat('x', 15 * r_regionkey::int) || '%%EOF' as c from region)
select k, strlen(c)::bigint as size, case when strlen(c) <= 60 and c[1:4] = '%PDF' then 'application/pdf' end as mime, case when strlen(c) > 60 then 'file_size' when c[1:4] <> '%PDF' then 'unsupported_format' end as reject_reason,
  case when strlen(c) <= 60 then lower(hex(c[1:8])) || ' (' || c[1:8] || ')' end as magic from d"""
ORACLES["records_read"] = """select 'r' || (c_custkey % 40)::varchar as id, max(c_custkey)::varchar as n from customer where c_custkey % 7 <> 0 and c_custkey % 11 <> 0 and c_custkey % 13 <> 0 group by c_custkey % 40
union all select 'broken', count(*)::varchar from customer where c_custkey % 7 <> 0 and (c_custkey % 11 = 0 or c_custkey % 13 = 0)"""
ORACLES["coordinates_read"] = "select * from (values " + ", ".join(f"('{version}', '{f}', {values(b)})" for version, fields in BOXES.items() for f, b in fields.items()) + ") as b(version, field_name, x1, y1, x2, y2)"
_SETTINGS = {"confidence_high": "0.92", "confidence_low": "0.7", "ocr_lang": "en"} | {k: str(x) for k, x in DEFAULTS.items()} | {"enable_deskew": "False", "clahe_tile_grid": "[4, 4]"}
ORACLES["settings_read"] = "select * from (values " + ", ".join(f"('{k}', '{x}')" for k, x in _SETTINGS.items()) + ") as s(setting, value)"
ORACLES["decisions_written"] = over_fields("select status, flag_reason, field_name, count(*) as n from routed where status <> 'accept' group by all", _ROUTED)
ORACLES["truth_written"] = over_fields("select id, field_name, gt as value from fields")
ORACLES["issues_streamed"] = """select case when user_id % 4 = 0 then 'text' else 'ocr' end as "table", (['accept', 'flag', 'escalate'])[(event_id % 3)::int + 1] as status, ts::date as date, count(*) as n from events where event_id % 3 <> 0 group by all"""
ORACLES["push_payloads"] = """select event_id as id, '{"data":{"image":"/data/local-files/?d=crops/' || (event_id % 5)::varchar || '","predicted_text":"v' || event_id::varchar || '","field":"' || event_type ||
  '"},"annotations":[{"result":[{"from_name":"transcription","to_name":"image","type":"textarea","value":{"text":["v' || event_id::varchar || '"]}}]}]}' as payload
from events where user_id % 2 <> 0 and user_id % 3 <> 0 and ts < timestamp '2024-01-19 23:00:00'"""

# -- compositions ---------------------------------------------------------------------------------

ORACLES["evaluation_summary"] = over_fields(
    "select field_name, count(*) as n, round(avg(exact_match::int), 6) as exact_match_rate, round(avg(cer), 6) as mean_cer, round(avg(wer), 6) as mean_wer, round(avg(missing::int), 6) as missing_rate from rated group by field_name",
    f"{_JOINED.format(value='raw').replace('from fields f', 'from (select * from fields where id in (select id from fields where present)) f')}, {_RATED}",
)
ORACLES["card_numbers"] = rf"with {CARDS} select k, upper(regexp_extract(text, {text(sp.PAN_LIKE)}, 1)) as pan_number, regexp_extract(text, {text(sp.DATE)}, 1) as dob from cards where doc_type = 'pan'"
ORACLES["region_texts"] = f"with {REGIONS} select doc_id as id, trim(string_agg(text, ' ' order by ord, text)) as name, '' as email, '0' as total_experience_years from regions group by doc_id"
