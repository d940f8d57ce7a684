"""Personal data as format-preserving Feistel pseudonyms (operator 9).

Card numbers (Luhn), phone numbers, IPv4 addresses (octets), ISO dates (calendar)
are found by pattern and validated; e-mail names and hexadecimal secrets are
handled the same way.  A value becomes a list of symbols with one modulus each,
a keyed Feistel network permutes the list, and the symbols are written back
into the value's own layout, so a pseudonym is valid in its format and equal
values get equal pseudonyms in every document under one key.

Feistel rounds change the left half by a keyed hash of the right half and then
the other way round; each round is a bijection on the halves, so distinct values
stay distinct.  Dates are day numbers in the 146097 days from 1800-01-01, which
factor as 189 x 773, so the network covers the range exactly.  Card numbers are
permuted without their check digit, which is then computed anew.  Area and exchange
codes of phone numbers that begin with 2 to 9, as valid ones do, go on doing so.

DataFrame functions only: one narrow pass, no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import doc_frame

#: Patterns by kind, in the order in which they are tried at a place.  Repeated groups
#: are possessive: the regex engine then loops over them, where it would recurse otherwise.
PATTERNS = {
    "secret": r"\b(?:password|passwd|secret|token|api_key)=[0-9a-f]{8,}+\b",
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"\+1 ?\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "date": r"(?<![\d-])(?:18|19|20|21)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "ipv4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
}
#: A whole run of digit groups, up to a date or address; PIECES finds the cards in it.
PATTERNS["card"] = rf"(?<![\d-])\d(?:[ -]?(?!{PATTERNS['date']}|{PATTERNS['ipv4']})\d){{12,}}+"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
DATE_FROM, DATE_MODULI = "1800-01-01", (189, 773)


def _whole(kind: str) -> str:
    return "^(?:" + PATTERNS[kind].replace("\\", "\\\\") + ")$"


#: SQL over a matched string v: its digits only; its Luhn sum is divisible by ten.
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(pmod(i, 2) = {odd},
  cast(substring({d}, length({d}) + 1 - i, 1) as int) * 2 - if(cast(substring({d}, length({d}) + 1 - i, 1) as int) > 4, 9, 0),
  cast(substring({d}, length({d}) + 1 - i, 1) as int)))"""

#: Kind of a match, null if it is not valid.
KIND = f"""
case when length(v) < 13 and v rlike '^[0-9]+[ -]?$' then null
     when v rlike '{_whole("secret")}' then 'secret'
     when v rlike '{_whole("email")}' then 'email'
     when v rlike '{_whole("phone")}' then 'phone'
     when v rlike '{_whole("date")}' then if(try_to_date(v, 'yyyy-MM-dd') is null, null, 'date')
     when v rlike '{_whole("ipv4")}' then if(forall(split(v, '[.]'), x -> cast(x as int) < 256 and (x = '0' or x not like '0%')), 'ipv4', null)
     when length({_DIGITS}) between 13 and 19 then if(pmod({_LUHN.format(d=_DIGITS, odd=0)}, 10) = 0, 'card', null) end"""

#: Pieces of a match m whose own kind decides each: of a run of digit groups the valid cards that
#: begin and end at group borders, longest first, and what is between them; else m itself.
#: A run is walked in steps of STEP groups, each of which looks AHEAD groups further, so that its cost
#: grows with its length; ``next`` is the first group that no piece holds yet, and ``upon`` has the
#: digits from there up to each later group.
STEP, AHEAD = 128, 19
_PLAIN = "replace(replace({x}, ' ', ''), '-', '')"
_RUN = "array_join(slice(g, i + 1, k), '')"
_LONG = "(upon[i - s.next + k] - upon[i - s.next])"
_UPON = f"aggregate(slice(n, s.next + 1, upto + {AHEAD} + 19 - s.next), array(0), (a, x) -> array_append(a, element_at(a, -1) + x))"
_VALID = f"""flatten(transform(sequence(s.next, least(upto + {AHEAD}, size(g)) - 1), i -> transform(
  filter(sequence(1, least(19, size(g) - i)), k -> {_LONG} between 13 and 19 and luhn_check({_PLAIN.format(x=_RUN)})),
  k -> named_struct('less', -{_LONG}, 'at', i, 'n', k))))"""
_CHOSEN = f"""filter(aggregate(array_sort({_VALID}), cast(array() as array<struct<less: int, at: int, n: int>>),
  (a, x) -> if(exists(a, y -> x.at < y.at + y.n and y.at < x.at + x.n), a, array_append(a, x))), y -> y.at < upto)"""
_OWN = "filter(cards, y -> y.at <= i and i < y.at + y.n)"
_CUT = f"""flatten(transform(sequence(s.next, till - 1), i -> case
       when size({_OWN}) = 0 then array(g[i])
       when {_OWN}[0].at < i then cast(array() as array<string>)
       else transform(array(array_join(slice(g, i + 1, {_OWN}[0].n), '')), r -> array(rtrim(' -', r), substring(r, length(rtrim(' -', r)) + 1)))[0] end))"""
_WALK = f"""aggregate(sequence(1, size(g), {STEP}), named_struct('next', 0, 'out', cast(array() as array<array<string>>)), (s, from) ->
  transform(array(least(from - 1 + {STEP}, size(g))), upto -> if(s.next >= upto, s,
    transform(transform(array({_UPON}), upon -> {_CHOSEN}), cards -> transform(array(aggregate(cards, upto, (a, y) -> greatest(a, y.at + y.n))), till ->
      named_struct('next', till, 'out', array_append(s.out, {_CUT})))[0])[0]))[0], s -> flatten(s.out))"""
PIECES = f"""
if(m rlike '^[0-9][0-9 -]+$' and length(regexp_replace(m, '[^0-9]', '')) >= 13,
   transform(array(regexp_extract_all(m, '[0-9]+[ -]?', 0)), g -> transform(array(transform(g, x -> length({_PLAIN.format(x="x")}))), n -> {_WALK})[0])[0],
   array(m))"""

_CHARS = "filter(split({s}, ''), c -> c <> '')"
_CODE = "case when c between '0' and '9' then ascii(c) - 48 when c between 'a' and 'z' then ascii(c) - 97 when c between 'A' and 'Z' then ascii(c) - 65 else 0 end"
_MODULUS = "case when c between '0' and '9' then 10 when c between 'a' and 'z' or c between 'A' and 'Z' then 26 else 1 end"
#: Of an address the name without leading punctuation, and the length of that punctuation.
_LOCAL = "regexp_replace(substring_index(v, '@', 1), '^[._%+-]+', '')"
_LEADING = f"(length(substring_index(v, '@', 1)) - length({_LOCAL}))"
_HEX = "substring_index(v, '=', -1)"

#: Symbols and moduli of a valid match.
SYMBOLS = f"""
case kind when 'card' then transform({_CHARS.format(s=f"substring({_DIGITS}, 1, length({_DIGITS}) - 1)")}, c -> cast(c as int))
          when 'phone' then transform({_CHARS.format(s=f"substring({_DIGITS}, 2, 10)")}, (c, i) -> if(i in (0, 3) and c >= '2', cast(c as int) - 2, cast(c as int)))
          when 'ipv4' then transform(split(v, '[.]'), c -> cast(c as int))
          when 'date' then array(cast(datediff(try_to_date(v, 'yyyy-MM-dd'), date'{DATE_FROM}') div {DATE_MODULI[1]} as int), cast(datediff(try_to_date(v, 'yyyy-MM-dd'), date'{DATE_FROM}') % {DATE_MODULI[1]} as int))
          when 'secret' then transform({_CHARS.format(s=_HEX)}, c -> cast(conv(c, 16, 10) as int))
          else transform({_CHARS.format(s=_LOCAL)}, c -> {_CODE}) end"""
MODULI = f"""
case kind when 'ipv4' then array_repeat(256, 4)
          when 'date' then array({DATE_MODULI[0]}, {DATE_MODULI[1]})
          when 'phone' then transform({_CHARS.format(s=f"substring({_DIGITS}, 2, 10)")}, (c, i) -> if(i in (0, 3), if(c >= '2', 8, 2), 10))
          when 'secret' then array_repeat(16, size(symbols))
          when 'email' then transform({_CHARS.format(s=_LOCAL)}, c -> {_MODULUS})
          else array_repeat(10, size(symbols)) end"""

_KEYED = "cast(conv(substring(sha2(concat_ws(':', '{key}', kind, k, i div 12, array_join({other}, ',')), 256), 1 + 5 * pmod(i, 12), 5), 16, 10) as int)"


def _network(key: str) -> str:
    left = f"transform(s.l, (x, i) -> if(k % 2 = 0, pmod(x + {_KEYED.format(key=key, other='s.r')}, moduli[i]), x))"
    right = f"transform(s.r, (x, i) -> if(k % 2 = 1, pmod(x + {_KEYED.format(key=key, other='s.l')}, moduli[i + size(s.l)]), x))"
    return f"""aggregate(sequence(0, {ROUNDS - 1}),
      named_struct('l', slice(symbols, 1, size(symbols) div 2), 'r', slice(symbols, size(symbols) div 2 + 1, size(symbols))),
      (s, k) -> named_struct('l', {left}, 'r', {right}), s -> concat(s.l, s.r))"""


#: Writes the permuted symbols back into the layout of v.
_PUT_DIGITS = "aggregate({chars}, named_struct('at', {skip}, 'out', ''), (a, c) -> named_struct('at', a.at + if(c between '0' and '9', 1, 0), 'out', concat(a.out, if(c between '0' and '9' and a.at >= 0, substring({digits}, a.at + 1, 1), c))), a -> a.out)"
_CHECKED = f"concat(array_join(permuted, ''), cast(pmod(10 - pmod({_LUHN.format(d='''array_join(permuted, '')''', odd=1)}, 10), 10) as string))"
_PHONE = "array_join(transform(permuted, (x, i) -> if(moduli[i] = 8, x + 2, x)), '')"
WRITE = f"""
case kind when 'card' then {_PUT_DIGITS.format(chars=_CHARS.format(s="v"), skip=0, digits=_CHECKED)}
          when 'phone' then {_PUT_DIGITS.format(chars=_CHARS.format(s="v"), skip=-1, digits=_PHONE)}
          when 'ipv4' then array_join(permuted, '.')
          when 'date' then cast(date_add(date'{DATE_FROM}', permuted[0] * {DATE_MODULI[1]} + permuted[1]) as string)
          when 'secret' then concat(substring_index(v, '=', 1), '=', array_join(transform(permuted, c -> lower(conv(c, 10, 16))), ''))
          when 'email' then concat(substring(v, 1, {_LEADING}), array_join(zip_with(permuted, {_CHARS.format(s=_LOCAL)}, (x, c) ->
               case when c between '0' and '9' then chr(48 + x) when c between 'a' and 'z' then chr(97 + x) when c between 'A' and 'Z' then chr(65 + x) else c end), ''),
               substring(v, {_LEADING} + length({_LOCAL}) + 1))
          else v end"""


def _steps(key: str) -> str:
    """SQL from a match v to (kind, pseudonym), each step bound once by a one-row transform."""
    bind = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    permuted = bind("permuted", _network(key), f"named_struct('kind', kind, 'pseudonym', {WRITE})")
    valid = bind("symbols", SYMBOLS, bind("moduli", MODULI, permuted))
    return bind("kind", KIND, f"if(kind is null, named_struct('kind', kind, 'pseudonym', v), {valid})")


def pseudonym(column: str, key: str) -> Column:
    """The pseudonym of a column that holds one value; a value of no valid kind stays as it is."""
    return F.expr(f"transform(array({column}), v -> {_steps(_quoted(key))})[0].pseudonym")


#: The key's literal carries this mark, by which Spark redacts it in plans, the UI and event logs.
KEY_MARK = "pseudonymkey"


def _quoted(key: str) -> str:
    if not key.isalnum():
        raise ValueError("the key must be letters and digits")
    return KEY_MARK + key


def hide_key(spark: SparkSession) -> None:
    """Have the session redact marked keys wherever it prints plans; an own pattern is kept."""
    name = "spark.sql.redaction.string.regex"
    own = spark.conf.get(name, None)
    if not own or KEY_MARK not in own:
        spark.conf.set(name, f"{own}|{KEY_MARK}[A-Za-z0-9]+" if own else f"{KEY_MARK}[A-Za-z0-9]+")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_replaced, kinds) of every document.

    text has every valid value replaced by its pseudonym and is otherwise unchanged;
    n_replaced counts them; kinds lists their kinds, sorted, joined by commas.  A null
    text stays null with 0 replaced; repeated rows are returned as often as they occur; an
    empty table gives an empty result.  The key is letters and digits; printed plans show a
    redaction in its place.
    """
    hide_key(docs.sparkSession)
    d = doc_frame(docs)
    any_ = F.lit(ANY)
    swapped = F.expr(f"transform(found, m -> transform({PIECES}, v -> {_steps(_quoted(key))}))")
    # a marker in an array keeps texts without a match away from the second and third scan
    found = F.when(F.col("text").rlike(ANY), F.regexp_extract_all("text", any_, F.lit(0))).otherwise(F.array().cast("array<string>"))
    parts = F.when(F.size("found") > 0, F.split("text", ANY, -1))
    joined = F.array_join(F.flatten(F.zip_with("parts", "swapped", lambda a, b: F.array(a, F.coalesce(F.array_join(b["pseudonym"], ""), F.lit(""))))), "")
    kinds = F.filter(F.transform(F.flatten("swapped"), lambda x: x["kind"]), lambda x: x.isNotNull())
    rows = d.withColumn("found", found).withColumn("parts", parts).withColumn("swapped", swapped)
    return rows.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"), F.size(kinds).cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"))
