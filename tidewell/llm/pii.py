"""Personal data by weak supervision.

Labelers vote on each candidate span: patterns, gazetteers, the words before it, and its shape.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, without
any labels; the posteriors then train a span classifier (naive Bayes over votes, context and length),
which decides on the candidates that the patterns alone leave open. All of it is DataFrame expressions;
the driver gets counts by vote pattern and by feature, both of which are bounded by construction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, read

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["pattern", "gazetteer", "context", "shape"]
#: Probability at which the classifier adds a span; buckets of the word before it; characters of context.
LEAST, BUCKETS, CONTEXT = 0.9, 64, 40

#: Patterns of the kinds. A run is tried from its start or the end of the last match only, so long runs cost no retries.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Looser forms: an address that is spelt out, a number without its country.
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+){1,8}"
LOCAL_PHONE = r"(?<![0-9+./-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Gazetteers and cue words: fixed lists.
DOMAINS = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "us", "ca", "au", "ch", "at", "be", "jp", "cn", "in", "br", "mx", "ru"]
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
COUNTRIES = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": ["mail", "e-mail", "email", "contact", "write", "courriel", "correo", "kontakt"],
    "ip": ["ip", "host", "server", "address", "login", "client", "adresse", "direccion"],
    "card": ["card", "visa", "mastercard", "credit", "payment", "carte", "karte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "contact", "telefon", "telefono"],
}
AGAINST = ["version", "isbn", "issn", "order", "page", "figure", "section", "serial", "doi", "release"]


def _let(value: str, name: str, body: str) -> str:
    """SQL of body with a value under a name, made once however often body names it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(v: str, level: int = 2, block: int = 64) -> str:
    """SQL of the sums before each number of an array: in blocks, whose totals are added up the same way, so that no fold copies more than a block."""
    fold = lambda x: f"aggregate({x}, array(0), (a{level}, n{level}) -> array_append(a{level}, element_at(a{level}, -1) + n{level}))"
    if not level:
        return _let(v, "v0", f"slice({fold('v0')}, 1, size(v0))")
    k = f"{level}"
    blocks = f"transform(sequence(0, greatest(0, size(v{k}) - 1) div {block}), c{k} -> {fold(f'slice(v{k}, c{k} * {block} + 1, {block})')})"
    totals = f"transform(b{k}, t{k} -> element_at(t{k}, -1))"
    joined = f"flatten(transform(b{k}, (w{k}, i{k}) -> transform(slice(w{k}, 1, size(w{k}) - 1), y{k} -> y{k} + o{k}[i{k}])))"
    return _let(v, f"v{k}", _let(blocks, f"b{k}", _let(_running(totals, level - 1, block), f"o{k}", joined)))


def _found(text: str, pattern: str, ok: str) -> str:
    """SQL for array<struct<s, e, t, before>>: matches x.t of a pattern in text that are ok, by code point, with the text before each.

    The pieces between matches and the matches themselves add up to the text, which gives the places. A match
    that is not ok only moves the place on: the work is in proportion to the text and its matches.
    """
    p = "r'" + pattern.replace("'", "\\'") + "'"
    lengths = "zip_with(m.p, m.h, (p, h) -> length(p) + length(h))"
    each = f"""filter(zip_with(zip_with(m.p, m.h, (p, h) -> struct(p as p, h as t)), {_running(lengths)}, (x, at) ->
        struct(at + length(x.p) as s, at + length(x.p) + length(x.t) as e, x.t as t, right(x.p, {CONTEXT}) as before)), x -> {ok})"""
    cut_ = _let(f"regexp_extract_all({text}, {p}, 0)", "h0", f"struct(h0 as h, slice(split({text}, {p}, -1), 1, size(h0)) as p)")
    return _let(cut_, "m", each)


def _digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """SQL: whether the digits d pass the check sum."""
    at = f"cast(substr({d}, length({d}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (a, k) -> a + if(k % 2 = 0, {at}, {at} * 2 - if({at} > 4, 9, 0))) % 10 = 0"


def _candidate(kind: str, base: str, gazetteer: str, shape: str, strict: str) -> str:
    """SQL of a candidate struct from a match c. base, gazetteer, shape: conditions; strict: the pattern's vote ('-' abstains)."""
    cue, against = "|".join(CUES[kind]), "|".join(AGAINST)
    context = f"case when rlike(lower(c.before), '(?:^|[^a-z])(?:{cue})[^a-z]') then '1' when rlike(lower(c.before), '(?:^|[^a-z])(?:{against})[^a-z]') then '0' else '-' end"
    vote = lambda x: f"case when {x} then '1' else '0' end"
    return f"""struct('{kind}' as kind, c.s as s, c.e as e, {base} as base, concat({strict}, {vote(gazetteer)}, {context}, {vote(shape)}) as votes,
        cast(pmod(xxhash64(lower(regexp_extract(c.before, '([^\\\\s]+)\\\\s*$', 1))), {BUCKETS}) as int) as bucket, least(length(c.t), 63) div 4 as size)"""


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, c: array of kind, s, e, base, votes, bucket, size for each row of docs; a null text counts as empty."""
    d, dx = _digits("c.t"), _digits("x.t")
    tld = "lower(element_at(split(c.t, '[.]|[(\\\\[]dot[)\\\\]] ?'), -1)) in (" + ", ".join(f"'{x}'" for x in DOMAINS) + ")"
    ip_ok = f"rlike(c.t, '^(?:0*{OCTET}[.]){{3}}0*{OCTET}$')"
    card_ok = f"length({d}) between 12 and 19 and {_luhn(d)}"
    yes_no = lambda x: f"case when {x} then '1' else '0' end"
    forms = [
        ("instr(t, '@') > 0", EMAIL, "true", _candidate("email", "true", tld, "length(substring_index(c.t, '@', 1)) <= 64", "'1'")),
        ("instr(t, '.') > 0", IP, "true", _candidate("ip", ip_ok, "not rlike(c.t, '^(?:0|127|255)[.]')", "not rlike(c.t, '(?:^|[.])0[0-9]')", yes_no(ip_ok))),
        ("true", CARD, f"length({dx}) between 12 and 19", _candidate("card", card_ok, f"rlike({d}, '{ISSUERS}')", f"length({d}) in (14, 15, 16)", yes_no(card_ok))),
        ("instr(t, '+') > 0", PHONE, f"length({dx}) between 9 and 15", _candidate("phone", "true", f"rlike({d}, '{COUNTRIES}')", f"length({d}) between 10 and 13", "'1'")),
        ("instr(t, 'at') > 0 and instr(t, 'dot') > 0", SPELT_EMAIL, "true", _candidate("email", "false", tld, "length(c.t) <= 80", "'-'")),
        ("true", LOCAL_PHONE, "true", _candidate("phone", "false", f"rlike({d}, '^[2-9]')", f"length({d}) = 10", "'-'")),
    ]
    arrays = [f"transform(if({when}, {_found('t', pattern, ok)}, null), c -> {made})" for when, pattern, ok, made in forms]
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    none = "cast(array() as array<struct<kind:string,s:int,e:int,base:boolean,votes:string,bucket:int,size:int>>)"
    each = text.select("doc_id", *[F.expr(f"if(rlike(t, '[0-9@]') or instr(t, 'dot') > 0, coalesce({a}, {none}), {none})").alias(f"c{k}") for k, a in enumerate(arrays)])
    return each.select("doc_id", F.flatten(F.array(*[f"c{k}" for k in range(len(arrays))])).alias("c"))


def reliabilities(counts: dict[tuple[str, str], int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """The probability of each (kind, votes) to be personal data, by expectation-maximisation over their counts.

    A labeler that abstains says nothing; each has a rate of yes among true spans and one among others.
    """
    post = {}
    for kind in KINDS:
        rows = [(v, n) for (k, v), n in sorted(counts.items()) if k == kind]
        q = {v: (1 + v.count("1")) / (2 + v.count("1") + v.count("0")) for v, _ in rows}
        for _ in range(rounds if rows else 0):
            total = sum(n for _, n in rows)
            prior = (sum(n * q[v] for v, n in rows) + 1) / (total + 2)
            rate = []
            for i in range(len(LABELERS)):
                yes = [sum(n * w for v, n in rows if v[i] == "1" for w in [q[v] if y else 1 - q[v]]) for y in (0, 1)]
                all_ = [sum(n * w for v, n in rows if v[i] != "-" for w in [q[v] if y else 1 - q[v]]) for y in (0, 1)]
                rate.append([(yes[0] + 1) / (all_[0] + 4), (yes[1] + 3) / (all_[1] + 4)])  # a labeler is taken to be right rather than wrong
            for v, _ in rows:
                odds = math.log(prior / (1 - prior))
                for i, x in enumerate(v):
                    if x != "-":
                        no, yes_ = (rate[i] if x == "1" else [1 - r for r in rate[i]])
                        odds += math.log(yes_ / no)
                q[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        post |= {(kind, v): x for v, x in q.items()}
    return post


def _map(values: dict[str, float]) -> Column:
    return F.from_json(F.lit("{" + ", ".join(f'"{k}": {v:.12g}' for k, v in sorted(values.items())) + "}"), "map<string,double>")


def _features(c: Column) -> Column:
    """Names of a candidate's features: each vote, the bucket of the word before it, its length."""
    votes = [F.concat(c["kind"], F.lit(f" {name} "), F.substring(c["votes"], i + 1, 1)) for i, name in enumerate(LABELERS)]
    return F.array(F.concat(c["kind"], F.lit(" prior")), *votes, F.concat(c["kind"], F.lit(" before "), c["bucket"].cast("string")), F.concat(c["kind"], F.lit(" size "), c["size"].cast("string")))


def classified(found: DataFrame) -> DataFrame:
    """found with p, the classifier's probability, in each candidate."""
    each = found.select(F.explode("c").alias("c"))
    counts = {(r["kind"], r["votes"]): r["count"] for r in each.groupBy("c.kind", "c.votes").count().collect()}  # 4 kinds times 3 ** 4 votes
    if not counts:
        return found.withColumn("c", F.transform("c", lambda c: c.withField("p", F.lit(0.0))))
    post = _map({f"{k} {v}": q for (k, v), q in reliabilities(counts).items()})
    soft = each.select("c", F.element_at(post, F.concat("c.kind", F.lit(" "), "c.votes")).alias("q"))
    sums = soft.select(F.explode(_features(F.col("c"))).alias("f"), "q").groupBy("f").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect()
    prior = {r["f"].split()[0]: (r["yes"], r["no"]) for r in sums if r["f"].endswith(" prior")}
    weight = {}
    for r in sums:
        yes, no = prior[r["f"].split()[0]]
        ratio = math.log((r["yes"] + 0.5) / (r["no"] + 0.5))
        weight[r["f"]] = ratio if r["f"].endswith(" prior") else ratio - math.log((yes + 0.5) / (no + 0.5))
    table = _map(weight)
    z = lambda c: F.aggregate(_features(c), F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    return found.withColumn("c", F.transform("c", lambda c: c.withField("p", 1 / (1 + F.exp(-z(c))))))


def spans(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, base, all: arrays of (s, kind number, kind:s:e) of the spans of each row of docs, in order.

    base: what the patterns and checks of the kinds find. all: those, and candidates that the classifier
    gives a probability of least or more and that overlap no base span and no added one before them.
    Null and empty texts have none; rows that repeat a doc_id are each returned.
    """
    found = classified(cut(candidates(docs)))
    number = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int")
    name = lambda c: F.struct(c["s"].alias("s"), number(c).alias("k"), F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string")).alias("n"))
    base = F.filter("c", lambda c: c["base"])
    apart = lambda c: ~F.exists("b", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    parts = found.select("doc_id", "c", base.alias("b")).withColumn("extra", F.array_sort(F.filter("c", lambda c: ~c["base"] & (c["p"] >= least) & apart(c)), lambda x, y: x["s"] - y["s"]))
    kept = F.expr("aggregate(extra, slice(extra, 1, 0), (a, x) -> if(size(a) > 0 and element_at(a, -1).e > x.s, a, array_append(a, x)))")
    return parts.select("doc_id", F.array_sort(F.transform("b", name)).alias("base"), F.array_sort(F.transform(F.concat("b", kept), name)).alias("all"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added of each document."""
    found = spans(read(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["n"]), ",")
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k + 1})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))
