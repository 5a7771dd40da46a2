r"""Surrogates for personal data (operator 8, DataFrame functions only).

One regular expression finds e-mail addresses, assigned secrets, IPv4 addresses, phone, social-security and
account numbers, IBANs and names behind an honorific. Every entity gets a keyed replacement of its type:

* numbers and addresses go through a keyed permutation of their own digits (or 32 bits): a Feistel network, a shift, and
  the network backwards. That is one-to-one and, as the shift has none, without a fixed point, so distinct entities stay distinct and none
  stays as it is, however many there are; separators, country code and issuer digit stay, and an IBAN gets check digits that are right
  if the original's were;
* e-mail addresses, secrets and names are built from a keyed hash of their normal form in the entity's
  script, case and length class; names keep the gender of their honorific, e-mail addresses the places of their dots,
  signs and digits (short ones get more letters, so that they can't coincide).

The same entity has the same surrogate in every document (coreference). Before the texts are rewritten, the
distinct entities of the whole table are checked for surrogates that coincide or that equal their original, and those from hashes for any
that equals another entity's original; on any, the key's salt and the length of hashed surrogates grow and the check is repeated.

Texts are rebuilt from the parts between the matches, so that no surrogate is ever searched again. Texts
without a digit, ``@``, ``=`` or honorific are passed through unread. Names are found behind an honorific only, secrets behind a keyword with at least 8 characters;
street addresses and passport numbers are not looked for. E-mail surrogates share one reserved domain. A permuted number can equal the real
number of another person (whose own is replaced as well). Scripts
without a surrogate alphabet get Latin letters.

Defined results: null texts stay null and empty texts empty, both with no entity; repeated rows get equal
results; an empty table gives an empty result; whole texts are searched; an input column ``pii_kinds`` is replaced; other columns of the input stay as they are (names that begin with
``_pii_`` are taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HONORIFIC = {"m": "Mr|Herr|Monsieur|Señor|господин", "f": "Mrs|Ms|Miss|Frau|Madame|Señora|госпожа", "n": "Dr|Prof|Professor"}
SECRET = r"""(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)(?:[_-][A-Za-z0-9_-]{1,40})?["']?[ \t]*[=:][ \t]*["']?[A-Za-z0-9_/+.\-]{8,}"""
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = {
    "secret": SECRET,
    "email": r"[\p{L}\p{N}._%+\-]{1,256}@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "account": r"(?:[0-9]{4}[ \-]){3}[0-9]{4}(?![0-9])|[0-9]{13,19}(?![0-9])",
    "name": rf"(?:{'|'.join(HONORIFIC.values())})\.? [\p{{Lu}}\p{{Lo}}][\p{{L}}\p{{M}}'\-]+(?: \p{{Lu}}[\p{{L}}\p{{M}}'\-]+){{0,2}}",
}
ENTITY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(KINDS.values()) + ")"
MAYBE = rf"[0-9@=]|(?:{'|'.join(HONORIFIC.values())})\.? |(?i:secret|token|key|passw)"

#: By script: 16 consonants and 16 vowels for the hexadecimal digits.
LETTERS = {"Han": ("安柏晨东方高海江林明南青山文小云", "宝春丹飞光和佳凯兰民宁平若思天学"), "Arabic": ("بتجحدرسشصطعفقكلم", "اويااويااويااويا"), "Hebrew": ("בגדזחטכלמנספצקרש", "איואאיואאיואאיוא"), "Cyrillic": ("бвгджзклмнпрстфх", "аеиоуаеиоуаеиоуа"), "Greek": ("βγδζθκλμνπρστφχψ", "αειουαειουαειουα"), "Latin": ("bcdfghjklmnprstv", "aeiouaeiouaeioua")}
HEX = "0123456789abcdef"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_script(of: str, i: int) -> str:
    """The 16 letters of the script that ``of`` is written in."""
    tests = "".join(f" when {of} rlike '\\\\p{{Is{k}}}' then {_sql(v[i])}" for k, v in LETTERS.items() if k != "Latin")
    return f"case{tests} else {_sql(LETTERS['Latin'][i])} end"


def _syllables(at: int, n: int) -> str:
    """``n`` syllables from the hash ``x.h`` at hexadecimal digit ``at``."""
    c, v = _by_script("x.rest", 0), _by_script("x.rest", 1)
    return f"concat({', '.join(f"translate(substr(x.h, {at + 2 * i}, 1), '{HEX}', {c}), translate(substr(x.h, {at + 2 * i + 1}, 1), '{HEX}', {v})" for i in range(n))})"


def _mod97(s: str) -> str:
    """The remainder by 97 of digits and letters, the letters as 10 to 35."""
    return f"aggregate(sequence(1, length({s})), 0, (a, i) -> if(substr({s}, i, 1) between '0' and '9', a * 10 + ascii(substr({s}, i, 1)) - 48, a * 100 + ascii(substr({s}, i, 1)) - 55) % 97)"


def _kind(raw: str) -> str:
    tests = "".join(f" when {raw} rlike {_sql('^(?:' + p + ')$')} then '{k}'" for k, p in KINDS.items())
    return f"case{tests} else 'account' end"


def surrogates(raws: str, key: str, salt: int = 0) -> str:
    """SQL for an array of ``struct(raw, kind, norm, sub)`` from an array of matches."""
    k = _sql(f"{key}|{salt}")
    e = f"transform({raws}, m -> struct(m as raw, {_kind('m')} as kind))"
    # what stays in front, and what is replaced
    kept = r"""case x.kind
      when 'secret' then regexp_extract(x.raw, '^((?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)(?:[_-][A-Za-z0-9_-]{1,40})?["\']?[ \\t]*[=:][ \\t]*["\']?)', 1)
      when 'name' then regexp_extract(x.raw, '^(\\S+ )', 1)
      when 'iban' then if(substr(x.raw, 5) rlike '[0-9].*[0-9]', substr(x.raw, 1, 4), substr(x.raw, 1, 2))
      when 'account' then substr(x.raw, 1, 1)
      when 'phone' then if(x.raw rlike '^\\+[0-9]{1,3}[ .(-]', regexp_extract(x.raw, '^(\\+[0-9]{1,3})', 1), regexp_extract(x.raw, '^(\\+(?:[17]|[0-9]{2}))', 1))
      else '' end"""
    e = f"transform({e}, x -> struct(x.raw as raw, x.kind as kind, {kept} as kept))"
    e = f"transform({e}, x -> struct(x.raw as raw, x.kind as kind, x.kept as kept, substr(x.raw, length(x.kept) + 1) as rest))"
    e = f"transform({e}, x -> struct(x.raw as raw, x.kind as kind, x.kept as kept, x.rest as rest, if(x.kind = 'email', lower(x.rest), if(x.kind in ('secret', 'name', 'ip'), x.rest, regexp_replace(x.rest, '[^0-9]', ''))) as norm))"
    o = [f"cast(split(x.norm, '[.]')[{i}] as bigint)" for i in range(4)]
    ten = "cast(pow(10, {}) as bigint)"
    half = "(length(x.norm) div 2)"
    number = "x.kind not in ('email', 'secret', 'name', 'ip')"
    e = f"""transform({e}, x -> struct(x.raw as raw, x.kind as kind, x.kept as kept, x.rest as rest, x.norm as norm,
      case when x.kind = 'ip' then {o[0]} * 256 + {o[1]} when {number} then coalesce(cast(substr(x.norm, 1, {half}) as bigint), 0L) else 0L end as l,
      case when x.kind = 'ip' then {o[2]} * 256 + {o[3]} when {number} then cast(substr(x.norm, {half} + 1) as bigint) else 0L end as r,
      case when x.kind = 'ip' then 65536L when {number} then {ten.format(half)} else 1L end as ml,
      case when x.kind = 'ip' then 65536L when {number} then {ten.format(f'(length(x.norm) - {half})')} else 1L end as mr,
      sha2(concat({k}, '|', x.kind, '|', x.norm), 256) as h))"""
    same = "x.raw as raw, x.kind as kind, x.kept as kept, x.rest as rest, x.norm as norm"
    mixed = "pmod({a} {sign} pmod(xxhash64({k}, x.kind, {i}, {b}, x.ml, x.mr), {m}), {m})"
    for i, sign in [*((i, "+") for i in range(6)), (6, ""), *((i, "-") for i in range(5, -1, -1))]:  # Feistel rounds, a shift, the rounds backwards
        left = mixed.format(a="x.l", b="x.r", m="x.ml", k=k, i=i, sign=sign) if i % 2 == 0 else "x.l"
        right = mixed.format(a="x.r", b="x.l", m="x.mr", k=k, i=i, sign=sign) if i % 2 else "x.r"
        if i == 6:
            by = "xxhash64({k}, x.kind, 'shift', '{part}', x.ml, x.mr)"
            left = f"(x.l + pmod({by.format(k=k, part='l')}, x.ml)) % x.ml"
            right = f"if(x.mr > 1, (x.r + 1 + pmod({by.format(k=k, part='r')}, x.mr - 1)) % x.mr, x.r)"
        e = f"transform({e}, x -> struct({same}, {left} as l, {right} as r, x.ml as ml, x.mr as mr, x.h as h))"
    digits = f"concat(if({half} = 0, '', lpad(cast(x.l as string), {half}, '0')), lpad(cast(x.r as string), length(x.norm) - {half}, '0'))"
    e = f"transform({e}, x -> struct({same}, x.l as l, x.r as r, x.h as h, if({number}, {digits}, '') as d))"
    put = "array_join(transform(sequence(1, length(x.rest)), i -> if(substr(x.rest, i, 1) between '0' and '9', substr(x.d, length(regexp_replace(substr(x.rest, 1, i), '[^0-9]', '')), 1), substr(x.rest, i, 1))), '')"
    local, digit = "substring_index(x.norm, '@', 1)", "substr(x.h, pmod(i - 1, 64) + 1, 1)"
    shaped = f"array_join(transform(sequence(1, length({local})), i -> case when substr({local}, i, 1) rlike '\\\\p{{N}}' then translate({digit}, '{HEX}', '0123456789012345') when substr({local}, i, 1) rlike '\\\\p{{L}}' then translate({digit}, '{HEX}', {_by_script('x.rest', 0)}) else substr({local}, i, 1) end), '')"
    more = f"greatest(0, {24 + 4 * salt} - length(regexp_replace({local}, '[^\\\\p{{L}}\\\\p{{N}}]', '')))"
    mail = f"concat({shaped}, translate(substr(sha2(concat('2|', x.h), 256), 1, {more}), '{HEX}', {_by_script('x.rest', 0)}), '@example.net')"
    hexes = f"substr(repeat(concat(x.h, sha2(concat('2|', x.h), 512), sha2(concat('3|', x.h), 512)), 1 + length(x.rest) div 300), 1, greatest({32 + 4 * salt}, length(x.rest)))"
    family = f"initcap({_syllables(20, 7 + salt)})"
    ending = " ".join(
        f"when x.kept rlike {_sql('^(?:' + HONORIFIC[g] + ')[.]? $')} then case when x.rest rlike '\\\\p{{IsCyrillic}}' then '{cyr}' when x.rest rlike '\\\\p{{IsGreek}}' then '{gr}' when x.rest rlike '\\\\p{{IsLatin}}' then '{lat}' else '' end"
        for g, cyr, gr, lat in (("m", "н", "ς", "n"), ("f", "на", "α", "na"))
    )
    ending = f"case {ending} else '' end"
    person = f"if(x.rest like '% %', concat(initcap({_syllables(1, 4)}), {ending}, ' ', {family}), concat({family}, {ending}))"
    cased = "if(x.rest = upper(x.rest) and x.rest <> lower(x.rest), upper({0}), {0})"
    sub = f"""case x.kind when 'email' then {cased.format(mail)} when 'secret' then {cased.format(hexes)} when 'name' then {cased.format(person)}
      when 'ip' then concat_ws('.', cast(x.l div 256 as string), cast(x.l % 256 as string), cast(x.r div 256 as string), cast(x.r % 256 as string))
      else {put} end"""
    e = f"transform({e}, x -> struct(x.raw as raw, x.kind as kind, x.kept as kept, x.rest as rest, x.norm as norm, {sub} as sub))"
    old, new = (_mod97(f"concat(regexp_replace({v}, ' ', ''), substr(x.kept, 1, 2), '00')") for v in ("x.rest", "x.sub"))
    checked = f"if(x.kind = 'iban' and length(x.kept) = 4, concat(substr(x.kept, 1, 2), lpad(cast(pmod(cast(substr(x.kept, 3) as int) + {old} - {new}, 100) as string), 2, '0')), x.kept)"
    return f"transform({e}, x -> struct(x.raw as raw, x.kind as kind, concat(x.kept, '|', x.norm) as norm, concat({checked}, x.sub) as sub))"


def _matches(text: Column) -> Column:
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def entities(docs: DataFrame, text_col: str = "text", key: str = "surrogate-key", salt: int = 0) -> DataFrame:
    """The distinct entities of all texts with their surrogates: ``raw``, ``kind``, ``norm``, ``sub``."""
    raw = docs.select(F.explode(F.array_distinct(_matches(F.col(text_col).cast("string")))).alias("raw")).distinct()
    return raw.select(F.explode(F.expr(surrogates("array(raw)", key, salt))).alias("e")).select("e.*")


def safe_salt(docs: DataFrame, text_col: str = "text", key: str = "surrogate-key", tries: int = 8) -> int:
    """The first salt under which all entities' surrogates are distinct and differ from their originals, hashed ones from all originals."""
    for salt in range(tries):
        e = entities(docs, text_col, key, salt)
        made = F.struct(F.regexp_replace(F.lower("sub"), "[ ().+-]", "").alias("s"), F.lower("norm").alias("who"), (F.col("raw") == F.col("sub")).alias("same"))
        real = F.struct(F.regexp_replace(F.lower("raw"), "[ ().+-]", "").alias("s"), F.lit(None).cast("string").alias("who"), F.lit(False).alias("same"))
        hashed = F.col("kind").isin("email", "secret", "name")
        both = e.select("kind", F.explode(F.when(hashed, F.array(made, real)).otherwise(F.array(made))).alias("v")).select("kind", "v.*")
        clash = both.groupBy("kind", "s").agg(F.min("who").alias("a"), F.max("who").alias("b"), F.max("same").alias("same"), F.max(F.col("who").isNull()).alias("real"))
        if not clash.where("same or (a <> b and kind in ('email', 'secret', 'name', 'ip')) or (real and a is not null)").head(1):
            return salt
    raise ValueError("no salt keeps the surrogates apart")


def pseudonymized(docs: DataFrame, text_col: str = "text", key: str = "surrogate-key", salt: int | None = None) -> DataFrame:
    """``docs`` with the text rewritten, and ``pii_kinds``, the sorted kinds of all its entities, repeats included."""
    salt = safe_salt(docs, text_col, key) if salt is None else salt
    text = F.col(text_col).cast("string")
    found = docs.withColumn("_pii_m", _matches(text)).withColumn("_pii_e", F.expr(surrogates("coalesce(_pii_m, array())", key, salt)))
    parts = found.withColumn("_pii_p", F.when(F.size("_pii_e") > 0, F.split(text, ENTITY)))
    rebuilt = "concat(array_join(zip_with(_pii_p, transform(_pii_e, x -> x.sub), (p, s) -> concat(p, coalesce(s, ''))), ''), '')"
    out = parts.withColumn(text_col, F.when(F.size("_pii_e") > 0, F.expr(rebuilt)).otherwise(text))
    return out.withColumn("pii_kinds", F.expr("array_sort(transform(_pii_e, x -> x.kind))")).drop("_pii_m", "_pii_e", "_pii_p")


def op8(spark, sf_dir: str) -> DataFrame:
    """Per document: ``doc_id``, the rewritten ``text``, ``n_entities`` and their ``kinds``, comma-joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymized(docs)
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_entities"), F.array_join("pii_kinds", ",").alias("kinds"))
