"""Format-preserving pseudonyms of personal data, in SQL functions only.

E-mail addresses, IBANs, social security numbers, dates, IPv4 addresses, phone
numbers and payment cards are found by one pattern and validated (checksums,
octets, calendar, digit counts); what fails stays as it is.  Each valid value
is permuted within its format by a keyed Feistel network, so the same value
becomes the same pseudonym in every document, different values different ones,
and a pseudonym is valid again:

* digits and letters keep their places, separators and case stay;
* a card's check digit and an IBAN's check digits are computed anew;
* dates move within the 400-year calendar cycle from 1800 (146,097 days, a
  grid of 189 by 773), social security numbers within the valid ones;
* a phone number keeps its digits before the last ten, an address its domain.

A state (a, b) on a grid of A by B goes through eight rounds, a = a + F(b) mod
A and b = b + F(a) mod B in turn, F a keyed SHA-256.  Grids of one row shift
by a keyed amount that is never zero.

Texts are taken apart at the matches and joined again, whole texts each;
nothing is shuffled.  Texts without two digits in a row, a dotted digit or an
at sign aren't searched further, as no pattern can match there.

The key is asked for by every function; ``key_of`` reads it from the session's
``spark.simloom.pii.key``.  Plans hold a digest of it, which is as secret as the
key itself: who has it can undo the pseudonyms.

Defined cases: a null text stays null and has no findings; empty texts stay
empty; an address whose local part has over 64 characters isn't one, of over
126 labels the first count; repeated rows get equal results; an empty table
gives no rows; all other columns pass through, also ones named as the findings.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.shared import free_name

#: The setting that names the key.
KEY_SETTING = "spark.simloom.pii.key"
ROUNDS = 8
KINDS = ("email", "iban", "ssn", "date", "ip", "phone", "card")
_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Local parts of up to 64 characters, up to 126 labels before the last: the limits of addresses, and of Java's recursion.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+"
IBAN = _B + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
DATE = _B + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4})" + _E
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})" + _E
CARD = _B + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}(?:\2[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _E
#: The patterns in order of precedence; group numbers in DATE and CARD count over all.
PATTERN = "|".join((EMAIL, IBAN, SSN, DATE, IP, PHONE, CARD))
POSSIBLE = r"@|[0-9][0-9]|[0-9]\.[0-9]"
#: Days of the calendar cycle from this day are a full grid.
FIRST_DAY, DAY_GRID = "1800-01-01", (189, 773)
#: Valid areas, and groups times serials.
SSN_GRID = (898, 99 * 9999)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ten_to(n: str) -> str:
    return f"element_at(array({', '.join(f'{10**k}L' for k in range(19))}), cast({n} as int) + 1)"


class _Build:
    """SQL of the pseudonyms under a key."""

    def __init__(self, key: str):
        self.key = f"'{hashlib.sha256(key.encode()).hexdigest()}'"

    def prf(self, tweak: str, i: str, x: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws('|', {self.key}, {tweak}, {i}, {x}), 256), 1, 15), 16, 10) as bigint)"

    def feistel(self, a: str, b: str, rows: str, columns: str, tweak: str) -> str:
        """A struct of a and b after all rounds."""
        step = f"(s, i) -> named_struct('a', case when i % 2 = 1 then (s.a + {self.prf(tweak, 'i', 's.b')}) % {rows} else s.a end, 'b', case when i % 2 = 0 then (s.b + {self.prf(tweak, 'i', 's.a')}) % {columns} else s.b end)"
        return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), {step})"

    def digits(self, value: str, tweak: str) -> str:
        """A digit string of up to 36 digits, permuted among those of its length."""
        half = "(length(dg) div 2)"
        whole = self.feistel(f"substr(dg, 1, cast({half} as int))", f"substr(dg, cast({half} as int) + 1)", _ten_to(half), _ten_to(f"length(dg) - {half}"), f"concat({tweak}, length(dg))")
        joined = _let(whole, "fr", f"concat(lpad(cast(fr.a as string), cast({half} as int), '0'), lpad(cast(fr.b as string), cast(length(dg) - {half} as int), '0'))")
        one = f"cast((cast(dg as bigint) + 1 + {self.prf(tweak, '0', chr(39) * 2)} % 9) % 10 as string)"
        return _let(value, "dg", f"case when length(dg) = 0 then dg when length(dg) = 1 then {one} else {joined} end")

    def letters(self, value: str, tweak: str) -> str:
        """Small letters, permuted by chunks of up to 12; each depends on those before."""
        number = "aggregate(split(ck, ''), 0L, (n, c) -> n * 26 + ascii(c) - 97)"
        power = lambda n: f"element_at(array({', '.join(f'{26**k}L' for k in range(7))}), cast({n} as int) + 1)"
        half = "(length(ck) div 2)"
        column = power(f"length(ck) - {half}")
        full = self.feistel(f"nr div {column}", f"nr % {column}", power(half), column, f"concat({tweak}, length(ck), w)")
        back = f"array_join(transform(sequence(length(ck) - 1, 0), k -> char(97 + (nw div element_at(array({', '.join(f'{26**k}L' for k in range(13))}), k + 1)) % 26)), '')"
        one = f"char(97 + (ascii(ck) - 96 + {self.prf(f'concat({tweak}, w)', '0', chr(39) * 2)} % 25) % 26)"
        many = _let(number, "nr", _let(_let(full, "fr", f"fr.a * {column} + fr.b"), "nw", back))
        chunk = _let("substr(lt, 12 * j + 1, 12)", "ck", f"case when length(ck) = 1 then {one} else {many} end")
        return _let(value, "lt", f"case when length(lt) = 0 then lt else aggregate(sequence(0, cast((length(lt) - 1) div 12 as int)), '', (w, j) -> concat(w, {chunk})) end")

    @staticmethod
    def placed(original: str, new: str, places: str) -> str:
        """``new``'s characters in the places of ``original`` that match, case kept."""
        before = f"length(regexp_replace(substr(og, 1, cast(at as int) + 1), '[^{places}]', ''))"
        pick = f"substr(nv, {before}, 1)"
        return _let(original, "og", _let(new, "nv", f"array_join(transform(split(og, ''), (c, at) -> case when not c rlike '[{places}]' then c when c rlike '[A-Z]' then upper({pick}) else {pick} end), '')"))

    # kinds

    def email(self, m: str) -> str:
        local, rest = f"substring_index({m}, '@', 1)", f"concat('@', substring_index({m}, '@', -1))"
        of = lambda places: f"regexp_replace(lower(lo), '[^{places}]', '')"
        with_letters = self.placed("lo", self.letters(of("a-z"), "concat('email', regexp_replace(lo, '[^0-9]', ''))"), "A-Za-z")
        # letters under the original digits, then digits under the new letters: both steps can be undone
        both = _let(with_letters, "l2", self.placed("l2", self.digits("regexp_replace(l2, '[^0-9]', '')", "concat('email', lower(regexp_replace(l2, '[^A-Za-z]', '')))"), "0-9"))
        return f"concat({_let(local, 'lo', both)}, {rest})"

    def card(self, m: str) -> str:
        payload = self.digits("substr(cd, 1, length(cd) - 1)", "'card'")
        checked = _let(payload, "pl", f"concat(pl, cast((10 - {luhn_sum('pl', 1)} % 10) % 10 as string))")
        return self.placed(m, _let(f"regexp_replace({m}, '[^0-9]', '')", "cd", checked), "0-9")

    def phone(self, m: str) -> str:
        kept = "greatest(0, length(ph) - 10)"
        new = f"concat(substr(ph, 1, {kept}), {self.digits(f'substr(ph, {kept} + 1)', chr(39) + 'phone' + chr(39))})"
        return self.placed(m, _let(f"regexp_replace({m}, '[^0-9]', '')", "ph", new), "0-9")

    def ip(self, m: str) -> str:
        part = lambda k: f"cast(element_at(oc, {k}) as bigint)"
        moved = self.feistel(f"{part(1)} * 256 + {part(2)}", f"{part(3)} * 256 + {part(4)}", "65536", "65536", "'ip'")
        return _let(f"split({m}, '[.]')", "oc", _let(moved, "fr", "concat_ws('.', fr.a div 256, fr.a % 256, fr.b div 256, fr.b % 256)"))

    def ssn(self, m: str) -> str:
        """Areas 001 to 899 without 666 are numbered from 0, as are groups and serials."""
        area = "cast(substr(sn, 1, 3) as bigint)"
        moved = self.feistel(f"{area} - 1 - cast({area} > 666 as bigint)", "(cast(substr(sn, 5, 2) as bigint) - 1) * 9999 + cast(substr(sn, 8, 4) as bigint) - 1", str(SSN_GRID[0]), str(SSN_GRID[1]), "'ssn'")
        return _let(m, "sn", _let(moved, "fr", "concat(lpad(fr.a + 1 + cast(fr.a >= 665 as int), 3, '0'), '-', lpad(fr.b div 9999 + 1, 2, '0'), '-', lpad(fr.b % 9999 + 1, 4, '0'))"))

    def date(self, m: str) -> str:
        days = f"datediff(make_date(ymd.y, ymd.m, ymd.d), date'{FIRST_DAY}')"
        moved = self.feistel(f"dy div {DAY_GRID[1]}", f"dy % {DAY_GRID[1]}", str(DAY_GRID[0]), str(DAY_GRID[1]), "'date'")
        pad = lambda value, width: f"lpad(cast({value} as string), greatest({width}, length(cast({value} as string))), '0')"
        iso = f"concat_ws('-', {pad('year(nd)', '4')}, {pad('month(nd)', '2')}, {pad('day(nd)', '2')})"
        first, second = "length(element_at(split(dt, '[/.]'), 1))", "length(element_at(split(dt, '[/.]'), 2))"
        other = f"concat_ws(case when dt like '%/%' then '/' else '.' end, {pad('case when ymd.md then month(nd) else day(nd) end', first)}, {pad('case when ymd.md then day(nd) else month(nd) end', second)}, {pad('year(nd)', '4')})"
        body = _let(days, "dy", _let(_let(moved, "fr", f"date_add(date'{FIRST_DAY}', cast(fr.a * {DAY_GRID[1]} + fr.b as int))"), "nd", f"case when dt like '____-%' then {iso} else {other} end"))
        return _let(m, "dt", _let(date_parts("dt"), "ymd", body))

    def iban(self, m: str) -> str:
        """The digits after country and check digits are permuted; letters stay."""
        rest = "substr(ib, 5)"
        rd = f"regexp_replace({rest}, '[^0-9]', '')"
        new = self.placed(rest, self.digits(rd, f"concat('iban', substr(ib, 1, 2), regexp_replace({rest}, '[0-9]', '-'))"), "0-9")
        checked = _let(new, "bb", f"concat(substr(ib, 1, 2), lpad(98 - {mod97(chr(99) + 'oncat(bb, substr(ib, 1, 2), ' + chr(39) + '00' + chr(39) + ')')}, 2, '0'), bb)")
        return self.placed(m, _let(f"replace({m}, ' ', '')", "ib", checked), "A-Z0-9")


def luhn_sum(d: str, doubled: int) -> str:
    """Luhn's sum of digits ``d``; those at odd places from the right count double if ``doubled`` is 1, else the even ones."""
    x = f"cast(substr({d}, length({d}) + 1 - q, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (t, q) -> t + case when q % 2 = {doubled} then ({x} * 2) % 10 + cast(({x} * 2) div 10 as int) else {x} end)"


def mod97(s: str) -> str:
    """An alphanumeric string mod 97, letters as 10 to 35."""
    return f"aggregate(split({s}, ''), 0, (t, c) -> cast(case when c rlike '[0-9]' then (t * 10 + ascii(c) - 48) % 97 else (t * 100 + ascii(c) - 55) % 97 end as int))"


def date_parts(m: str) -> str:
    """Year, month, day, and whether the month comes first (only if the day can't)."""
    p = lambda k: f"cast(element_at(split({m}, '[-/.]'), {k}) as int)"
    first = f"({p(1)} <= 12 and {p(2)} > 12)"
    return f"case when {m} like '____-%' then named_struct('y', {p(1)}, 'm', {p(2)}, 'd', {p(3)}, 'md', false) else named_struct('y', {p(3)}, 'm', case when {first} then {p(1)} else {p(2)} end, 'd', case when {first} then {p(2)} else {p(1)} end, 'md', {first}) end"


def _kind(m: str) -> str:
    """SQL of a match's kind, null if it isn't valid."""
    whole = lambda p: f"{m} rlike {_sql('^(?:' + p + ')$')}"
    number = f"regexp_replace({m}, '[^0-9]', '')"
    part = lambda sep, k: f"cast(element_at(split({m}, '{sep}'), {k}) as int)"
    octets = " and ".join(f"{part('[.]', k)} <= 255" for k in range(1, 5))
    ssn = f"{part('-', 1)} between 1 and 899 and {part('-', 1)} <> 666 and {part('-', 2)} > 0 and {part('-', 3)} > 0"
    leap = "(dp.y % 4 = 0 and (dp.y % 100 <> 0 or dp.y % 400 = 0))"
    last = f"element_at(array(31, 28 + cast({leap} as int), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), greatest(1, least(12, dp.m)))"
    day = _let(date_parts(m), "dp", f"dp.y between 1800 and 2199 and dp.m between 1 and 12 and dp.d between 1 and {last}")
    plain = f"replace({m}, ' ', '')"
    return (
        f"case when instr({m}, '@') > 0 then 'email'"
        f" when {whole('[A-Z]{2}.*')} then case when length({plain}) between 15 and 34 and {mod97(f'concat(substr({plain}, 5), substr({plain}, 1, 4))')} = 1 then 'iban' end"
        f" when {whole('[0-9]{3}-[0-9]{2}-[0-9]{4}')} then case when {ssn} then 'ssn' end"
        f" when {whole('[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}' + chr(92) + '1[0-9]{4}')} then case when {day} then 'date' end"
        f" when {whole('([0-9]{1,3}[.]){3}[0-9]{1,3}')} then case when {octets} then 'ip' end"
        f" when {whole('[+(].*|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}')} then case when length({number}) between 7 and 15 then 'phone' end"
        f" when {luhn_sum(number, 0)} % 10 = 0 and length({number}) between 13 and 19 then 'card' end"
    )


def key_of(spark: SparkSession, default: str | None = None) -> str:
    """The session's key; ``default``, if given, only serves where none is set."""
    key = spark.conf.get(KEY_SETTING, None) or default
    if not key:
        raise ValueError(f"{KEY_SETTING} must name the key of the pseudonyms")
    return key


def found_and_replaced(df: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, Column, Column]:
    """``df`` with helper columns, the pseudonymised text, and the kinds of what was replaced."""
    build = _Build(key)
    found, gaps, news = (free_name(df, n) for n in ("pii_found", "pii_gaps", "pii_news"))
    may = F.coalesce(F.col(text).rlike(POSSIBLE), F.lit(False))
    out = df.withColumn(found, F.when(may, F.regexp_extract_all(text, F.lit(f"(?:{PATTERN})"), F.lit(0))))
    some = F.coalesce(F.size(found) > 0, F.lit(False))
    new = " ".join(f"when '{k}' then {getattr(build, k)('m')}" for k in KINDS)
    each = f"transform(`{found}`, m -> {_let(_kind('m'), 'kd', f'named_struct({chr(39)}k{chr(39)}, kd, {chr(39)}m{chr(39)}, case kd {new} else m end)')})"
    out = out.withColumns({gaps: F.when(some, F.split(text, PATTERN, -1)), news: F.when(some, F.expr(each))})
    pairs = F.zip_with(gaps, F.transform(news, lambda x: x["m"]), lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))
    replaced = F.when(some, F.array_join(F.flatten(pairs), "")).otherwise(F.col(text))
    return out, replaced, F.transform(F.filter(news, lambda x: x["k"].isNotNull()), lambda x: x["k"])


def pseudonymised(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with its text pseudonymised, columns as before."""
    out, replaced, _ = found_and_replaced(df, key, text)
    return out.select(*[replaced.alias(c) if c == text else F.col(c) for c in df.columns])


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the whole text with pseudonyms, and counts by kind."""
    out, replaced, kinds = found_and_replaced(docs.select("doc_id", "text"), key)
    one = out.select("doc_id", replaced.alias("text"), kinds.alias("kinds"))
    return one.select("doc_id", "text", *[F.coalesce(F.when(F.size("kinds") > 0, F.size(F.array_remove(F.transform("kinds", _equals(k)), False))), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS])


def _equals(name: str):
    return lambda k: k == name
