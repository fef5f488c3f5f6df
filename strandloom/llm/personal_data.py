"""Personal data by weak supervision.

Native: DataFrame functions only; the driver sees tables of vote patterns and feature
patterns, whose sizes are products of small numbers whatever the corpus.

Spans of the four base kinds are matched and validated, and they stay.  What narrowly failed
validation, and what looser patterns propose, are candidates too, unless they touch a base
span.  Labelers vote on every candidate (for, against, or nothing): check digits and ranges,
gazetteers of domains, prefixes and fillers, cue words around the span, its borders and its
shape.  Expectation-maximisation estimates how reliable each labeler is for each kind, without
any labels, and with it how likely each pattern of votes is.  A logistic span classifier is
trained on these probabilities over features of the spans, base spans among them; it alone
decides which candidates are personal data too.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty

#: Base kinds in the order of the result.  Possessive: none of these patterns has to give back
#: what it took, and long runs neither recurse nor backtrack.  A match of a run of characters
#: begins where the run does, or where the match before has ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words that end or begin a street's name, and titles of persons.
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square|Court|Terrace"
STRASSEN = "stra\u00dfe|strasse|gasse|platz|allee"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Se\u00f1or|Se\u00f1ora"
#: Further candidates: name, kind and pattern.
MORE = {
    "local_phone": ("phone", r"(?<![0-9A-Za-z+.()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    "spelt_email": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20at\x20|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:\x20dot\x20|\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{2,}(?![A-Za-z0-9])"),
    "assigned_secret": ("secret", r"(?<![A-Za-z])(?:password|passwd|secret|token|api[_-]?key)[\x20\t]{0,3}[=:][\x20\t]{0,3}[\x22']?[A-Za-z0-9_/+-]{8,}+[\x22']?"),
    "key_secret": ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])"),
    "iban": ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_number": ("national", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "titled_name": ("person", rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?"),
    "street": ("street", rf"(?<![\p{{L}}\p{{N}}])[0-9]{{1,5}}\x20(?:\p{{Lu}}\p{{Ll}}++\x20){{1,3}}(?:{STREETS})(?![\p{{L}}\p{{N}}])|(?<![\p{{L}}\p{{N}}])\p{{Lu}}[\p{{Ll}}-]*(?:{STRASSEN})\x20[0-9]{{1,4}}(?![\p{{L}}\p{{N}}])"),
}
KINDS = ["email", "ip", "card", "phone", "secret", "account", "national", "person", "street"]
#: A pattern is tried where the text has one of these, as all its hits do; one without a hint where it has a digit.
HINTS = {
    "email": ("@",), "phone": ("+",), "spelt_email": (" at ", "(at)", "[at]", "(at]", "[at)"), "assigned_secret": ("password", "passwd", "secret", "token", "api"),
    "key_secret": ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox"), "national_number": ("-",), "titled_name": tuple(TITLES.split("|")), "street": tuple(f"{STREETS}|{STRASSEN}".split("|")),
}
#: A candidate that failed the check of its base kind has so many digits.
NEAR_MISS = {"ip": (4, 16), "card": (12, 20), "phone": (7, 17)}
CONTEXT = 24

#: Gazetteers.
DOMAINS = "com org net edu gov mil int info biz name io co me ai app dev cloud online de at ch fr es it nl be lu uk ie eu us ca mx br ar cl au nz jp cn kr in ru ua pl cz sk hu ro bg gr tr se no dk fi is pt il za".split()
CARD_PREFIX = "^(4|5[1-5]|2[2-7]|3[47]|30[0-5]|36|38|39|6011|64[4-9]|65|35[2-8]|62)"
#: Country codes by their first digits: of one digit, of two, and else of three.
COUNTRY_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-3]|50[0-9]|59[0-9]|6[789][0-9]|80[08]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9]"
IBAN_COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR|UA"
FILLERS = "changeme|example|placeholder|password|required|optional|undefined|default|your|xxxx|none|null|true|false"
RESERVED_IPS = "^(0|127|255|10|192\\.0\\.2|192\\.168|198\\.51\\.100|203\\.0\\.113)\\."
#: Cue words around a span, by kind, and words against all kinds and against numbers.
CUES = {
    "email": "mail|e-mail|email|contact|write|reach|address", "ip": "host|server|client|login|logged|from|address|ip|peer",
    "card": "card|visa|mastercard|amex|credit|debit|paid|payment", "phone": "call|phone|tel|mobile|cell|fax|whatsapp|ring|dial|reach|contact",
    "secret": "login|user|account|aws|auth|credential|credentials|config|env|export", "account": "iban|account|bank|transfer|payable|bic",
    "national": "ssn|social security|national|insurance|tax|passport|id", "person": "dear|contact|sincerely|regards|patient|signed|born|lives", "street": "address|lives|living|located|home|ship|deliver|resident",
}
AGAINST = "version|page|isbn|issn|doi|no\\.|chapter|section|figure|table|serial|order|invoice|tracking|sku|part|model|example|sample|test|dummy|build|release"


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    digit = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    doubled = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda sum_, i: sum_ + F.when(i % 2 == 1, digit(i)).otherwise(doubled(digit(i))))
    return total % 10 == 0


def iban_holds(hit: Column) -> Column:
    """The check of an account number: its first four characters moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)).cast("int")) == 1


def valid(name: Column, hit: Column) -> Column:
    """The checks of the base kinds and of other numbers that have one; null for other candidates."""
    digits = digits_of(hit)
    part = lambda p: F.ltrim(p, F.lit("0"))
    small = F.forall(F.split(hit, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    card = F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    base = F.when(name == "email", True).when(name == "ip", small).when(name == "card", card).when(name == "phone", F.length(digits).between(9, 15))
    national = ~digits.rlike("^(000|666|9)") & ~digits.rlike("^...00") & ~digits.rlike("0000$")
    return base.when(name == "iban", iban_holds(hit)).when(name == "national_number", national).when(name == "local_phone", digits.rlike("^[2-9]..[2-9]"))


def _hit_of(name: str):  # noqa: ANN202
    return lambda x, i: F.struct(F.lit(name).alias("name"), i.alias("place"), x["gap"]["n"].alias("gap"), x["hit"].alias("hit"), x["gap"]["tail"].alias("left"), x["next"]["head"].alias("right"))


def located(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rid, row) of docs, and the candidates (rid, name, hit, left, right, start, end) in code points."""
    patterns = {**BASE, **{k: p for k, (_, p) in MORE.items()}}
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text_or_empty().alias("text"))
    has_digit = F.col("text").rlike("[0-9]")
    arrays = []
    for name, pattern in patterns.items():
        hint = HINTS.get(name)
        there = has_digit if hint is None else reduce(or_, [F.contains("text", F.lit(x)) for x in hint])
        slim = slim.withColumn(f"g_{name}", F.when(there, F.split("text", pattern, -1))).withColumn(f"h_{name}", F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
        # what stands between the hits is kept as its length and its ends only
        gaps = F.transform(f"g_{name}", lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("tail"), F.left(g, F.lit(CONTEXT)).alias("head")))
        zipped = F.arrays_zip(gaps.alias("gap"), F.col(f"h_{name}").alias("hit"), F.slice(gaps, 2, 1 << 30).alias("next"))
        rows = F.transform(zipped, _hit_of(name))
        arrays.append(F.coalesce(F.filter(rows, lambda x: x["hit"].isNotNull()), F.array().cast("array<struct<name:string,place:int,gap:int,hit:string,left:string,right:string>>")))
    hits = materialize(slim.select("row", F.concat(*arrays).alias("hits")).withColumn("rid", F.monotonically_increasing_id()), "personal-hits")
    one = hits.filter(F.size("hits") > 0).select("rid", F.explode("hits").alias("x")).select("rid", "x.*")
    order = Window.partitionBy("rid", "name").orderBy("place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("hit").cast("long")
    start = F.sum(F.col("gap").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(length).over(before), F.lit(0))
    spans = one.select("rid", "name", "hit", "left", "right", start.alias("start")).withColumn("end", F.col("start") + length)
    return hits.select("rid", "row"), spans


LABELERS = ["validity", "gazetteer", "context", "border", "shape"]


def votes(spans: DataFrame) -> DataFrame:
    """Candidates among spans, with kind, check (passed, failed or none), base (a valid span of a base kind) and the labelers' votes: 1, -1 or 0.

    Base spans are candidates too; others are unless they touch one.
    """
    name, hit = F.col("name"), F.col("hit")
    kinds = {**{k: k for k in BASE}, **{k: kind for k, (kind, _) in MORE.items()}}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[name]
    digits = digits_of(hit)
    vote = lambda yes, no=None: F.when(yes, 1).when(~yes if no is None else no, -1).otherwise(0)
    either = lambda words: "(" + "|".join(words) + ")"
    value = F.regexp_replace(hit, "^[^=:]*[=:][\\s\x22']*|[\x22']$", "")  # of an assignment
    gazetteer = (
        F.when(kind == "email", vote(F.lower(hit).rlike(f"[. )\\]]{either(DOMAINS)}$")))
        .when(kind == "ip", vote(~hit.rlike(RESERVED_IPS)))
        .when(kind == "card", vote(digits.rlike(CARD_PREFIX)))
        .when(name == "phone", vote(digits.rlike(f"^({COUNTRY_CODES})")))
        .when(name == "iban", vote(hit.rlike(f"^({IBAN_COUNTRIES})")))
        .when(name == "key_secret", F.lit(1))
        .when(name == "assigned_secret", vote(F.lit(False), F.lower(value).rlike(FILLERS)))
        .otherwise(0)
    )
    around = F.lower(F.concat_ws(" ", F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))))
    cues = F.create_map(*[F.lit(x) for k, words in CUES.items() for x in (k, f"\\b({words})\\b")])[kind]
    cue, against = F.regexp_like(around, cues), around.rlike(f"\\b({AGAINST})")
    context = F.when(cue & ~against, 1).when(against & ~cue, -1).otherwise(0)
    inside = F.col("left").rlike("[\\p{L}\\p{N}]$") | F.coalesce(F.col("right"), F.lit("")).rlike("^[\\p{L}\\p{N}]")
    flat = F.length(digits) >= 4
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 10)
    shape = F.when(flat & (digits.rlike("^([0-9])\\1*$") | F.contains(F.lit("01234567890123456789"), digits)), -1).when(kind == "secret", vote(mixed | (name == "key_secret"))).otherwise(0)
    outcome = valid(name, hit)
    near = F.lit(True)
    for k, (low, high) in NEAR_MISS.items():
        near = near & F.when((name == k) & ~F.col("holds"), F.length(digits).between(low, high)).otherwise(True)
    checked = spans.withColumn("kind", kind).withColumn("holds", outcome).filter(near).withColumn("base", F.coalesce("holds", F.lit(False)) & name.isin(*BASE))
    along = Window.partitionBy("rid").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(along.rowsBetween(1, Window.unboundedFollowing))
    apart = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    checked = checked.withColumn("apart", apart).filter("base or apart")
    return checked.select(
        "rid", "name", "kind", "hit", "left", "right", "start", "end", "base",
        F.when(F.col("holds"), "passed").when(~F.col("holds"), "failed").otherwise("none").alias("check"),
        # passing says something only where few numbers pass: check digits, and an address's form
        F.when(~F.col("holds"), -1).when(F.col("holds") & name.isin("email", "card", "iban"), 1).otherwise(0).alias("validity"),
        gazetteer.alias("gazetteer"), context.alias("context"), F.when(inside, -1).otherwise(0).alias("border"), shape.alias("shape"),
    )


#: What is thought of a labeler before it is seen at work: right on so many spans of either truth, and wrong on so many.
RIGHT, WRONG = 8.0, 2.0
#: A vote makes a span likelier or less likely by this factor at least, whatever is estimated: labelers that never
#: meet another opinion could else be taken for wrong.  A check that failed is no opinion at all.
LEAST = {"validity": 20.0, "gazetteer": 1.75, "context": 1.75, "border": 1.75, "shape": 1.75}
#: The chance of a candidate about which no labeler votes: its form speaks for it.  It is not estimated, as nothing
#: but the votes themselves could tell.
PRIOR = 0.6


def reliabilities(rows: list[tuple], rounds: int = 40) -> tuple[dict[tuple[str, str], tuple[float, float]], dict[tuple, float]]:
    """Expectation-maximisation over patterns (kind, votes, count).

    Returns for each kind and labeler how often it votes for what is personal data and against
    what is not, where it votes at all; and for each (kind, votes) the probability that it is.
    Starts from the majority of the votes.
    """
    chance = {(k, v): min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for k, v, _ in rows}
    table: dict[tuple[str, str], tuple[float, float]] = {}
    kinds = sorted({r[0] for r in rows})
    for _ in range(rounds):
        for kind in kinds:
            mine = [(v, n) for k, v, n in rows if k == kind]
            for i, name in enumerate(LABELERS):
                for_true, against_true, for_false, against_false = RIGHT, WRONG, WRONG, RIGHT
                for v, n in mine:
                    p = chance[kind, v]
                    for_true, for_false = for_true + n * p * (v[i] > 0), for_false + n * (1 - p) * (v[i] > 0)
                    against_true, against_false = against_true + n * p * (v[i] < 0), against_false + n * (1 - p) * (v[i] < 0)
                table[kind, name] = for_true / (for_true + against_true), against_false / (for_false + against_false)
        for k, v, _ in rows:
            odds = math.log(PRIOR / (1 - PRIOR))
            for i, name in enumerate(LABELERS):
                yes, no = table[k, name]
                if v[i] > 0:
                    odds += max(math.log(yes / (1 - no)), math.log(LEAST[name]))
                elif v[i] < 0:
                    odds += min(math.log((1 - yes) / no), -math.log(LEAST[name]))
            chance[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return table, chance


FEATURES = ["kind_check", "in_gazetteer", "in_context", "at_border", "in_shape", "length_class", "digit_share", "spread", "left_kind", "right_kind"]


def features(voted: DataFrame) -> DataFrame:
    """Names that describe a span, all as strings; the classifier has one weight for each value.

    What a labeler saw counts by kind, as does the outcome of the check, so that a kind has evidence of its own.
    """
    hit, n = F.col("hit"), F.length("hit")
    side = lambda c, pattern: F.when(F.coalesce(c, F.lit("")) == "", "none").when(c.rlike(pattern.format("[\\s]")), "space").when(c.rlike(pattern.format("[\\p{L}\\p{N}]")), "word").otherwise("mark")
    by_kind = lambda c: F.concat_ws(" ", "kind", F.col(c).cast("string"))
    return voted.select(
        "*", by_kind("check").alias("kind_check"), by_kind("gazetteer").alias("in_gazetteer"), by_kind("context").alias("in_context"),
        by_kind("border").alias("at_border"), by_kind("shape").alias("in_shape"),
        F.least(F.floor(F.log2(n.cast("double"))), F.lit(7)).cast("string").alias("length_class"),
        F.floor(F.length(digits_of(hit)) * 4 / n).cast("string").alias("digit_share"),
        F.least(n - F.length(F.regexp_replace(hit, "[\\x20().-]", "")), F.lit(6)).cast("string").alias("spread"),
        side(F.col("left"), "{}$").alias("left_kind"), side(F.col("right"), "^{}").alias("right_kind"),
    )


def fit(rows: list[tuple[tuple, float, float]], rounds: int = 25) -> dict[tuple[str, str], float]:
    """Logistic regression by Newton's method on patterns (values, count, expected positives); ridge 1."""
    names = sorted({(f, v) for values, _, _ in rows for f, v in zip(FEATURES, values, strict=True)})
    index = {x: i + 1 for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for r, (values, _, _) in enumerate(rows):
        for f, v in zip(FEATURES, values, strict=True):
            x[r, index[f, v]] = 1
    n, y = (np.array([r[i] for r in rows], float) for i in (1, 2))
    w = np.zeros(len(names) + 1)
    for _ in range(rounds if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - n * p) - w)
        w += np.clip(step, -4, 4)
    return {("", ""): float(w[0]), **{k: float(w[i]) for k, i in index.items()}}


def classified(candidates: DataFrame, rounds: int = 40) -> DataFrame:
    """candidates with the classifier's probability ``score``; everything is learned from the candidates themselves."""
    counts = candidates.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** 5 for each kind at most
    _, chance = reliabilities(sorted((r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in counts), rounds)
    spark = candidates.sparkSession
    rows = [(k, *v, p) for (k, v), p in sorted(chance.items())]
    table = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{x} int" for x in LABELERS) + ", chance double")
    likely = features(candidates).join(F.broadcast(table), ["kind", *LABELERS])
    patterns = likely.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("chance").alias("y")).collect()  # a few thousand at most
    weights = fit(sorted((tuple(r[f] for f in FEATURES), r["n"], r["y"]) for r in patterns))
    total = F.lit(weights[("", "")])
    for f in FEATURES:
        of = {v: w for (g, v), w in weights.items() if g == f}
        if of:
            total = total + F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col(f)], F.lit(0.0))
    return likely.withColumn("score", 1 / (1 + F.exp(-total)))


def find(docs: DataFrame, keep: list[str] | None = None, threshold: float = 0.5, rounds: int = 40) -> DataFrame:
    """docs (text, ...) as (row, base, added): arrays of (number, start, end, kind), sorted by kind as listed, then start.

    Positions are code points, ends exclusive.  ``added`` are the candidates that the classifier
    takes; they touch no base span, and of added ones that touch the first stays.  ``rounds`` of
    expectation-maximisation; with 0 the labelers' majority decides.  Null and empty texts have
    no spans, texts of any length are searched whole, repeated rows one by one; columns of docs
    may have any names; an empty table gives an empty one.
    """
    columns = docs.columns if keep is None else keep
    rows, spans = located(docs, columns)
    candidates = materialize(votes(spans), "personal-votes")
    scored = classified(candidates, rounds)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])[F.col("kind")]
    span = F.struct("number", "start", "end", "kind")
    taken = scored.filter(F.col("base") | (F.col("score") >= threshold)).withColumn("number", number)
    along = Window.partitionBy("rid", "base").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("free", F.col("base") | F.coalesce(F.max("end").over(along) <= F.col("start"), F.lit(True))).filter("free")
    of_doc = taken.groupBy(F.col("rid").alias("of")).agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.array_sort(F.collect_list(F.when(~F.col("base"), span))).alias("added"),
    )
    empty = F.array().cast(of_doc.schema["base"].dataType)
    joined = rows.join(of_doc, F.col("rid") == F.col("of"), "left")
    return joined.select("row", F.coalesce("base", empty).alias("base"), F.coalesce("added", empty).alias("added"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) of every document."""
    found = find(documents(spark, sf_dir), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind))
    counts = [count(kind).cast("long").alias(f"n_{kind}") for kind in BASE]
    spans = written(F.array_sort(F.concat("base", "added")))
    n_added = F.size("added").cast("long")
    return found.select(
        "row.doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.alias("spans"),
        n_added.alias("n_added"), (F.size("base") + n_added).alias("n_spans"),
    )
