"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier is trained.

Strict patterns with a check (address parts, Luhn, number of digits) give the base spans, which stay whatever comes after.
Matches that fail the check and matches of looser patterns are further candidates. Five labelers vote 1, 0 or not at all on
every candidate: pattern, check, gazetteer, words around it, characters next to it. Expectation-maximisation over the counts
of vote patterns (972 at most) estimates how often each labeler is right, by kind; every candidate then weighs in a naive
Bayes classifier over what it looks like and where it stands, whose cells are bounded in number too. Candidates that the
classifier is sure of are added where they touch no base span.

Texts are read once, in the rows they are in: only counts are shuffled. Patterns have possessive quantifiers and start at the
beginning of a run, so they give what the plain patterns give, in time linear in the text and without deep recursion.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted

KINDS = ("email", "ip", "card", "phone")
# The four base patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser ones: an address in words or brackets, the longer internet addresses, cards next to other numbers, national telephone numbers.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({](?:at|AT|@)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({](?:dot|DOT|\.)[\])}])\x20?[A-Za-z0-9-]++)++"
LOOSE_IP = r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Za-z:])"
LOOSE_CARD = r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.)-])(?:\(0?[0-9]{2,4}\)|00?[0-9]{2,4}+)[\x20./-][0-9]{3,4}+(?:[\x20./-]?[0-9]{2,4}+)?+[\x20./-]?[0-9]{2,5}+(?![0-9A-Za-z])"
# Gazetteers: ends of domains, first digits of cards, calling codes.
DOMAIN_ENDS = "com net org edu gov io co info biz de fr es it nl uk ie ch at be pl pt se no dk fi eu us ca mx br au nz jp cn in ru example".split()
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30|35|6011|62|64|65)"
CALLING = r"^(?:1|7|2[07]|21[1268]|22\d|23\d|24\d|25\d|26\d|29\d|3[0-469]|35\d|37\d|38\d|4[013-9]|42\d|5[1-8]|50\d|59\d|6[0-6]|67\d|68\d|69\d|8[1246]|85\d|88\d|9[0-58]|96\d|97\d|99\d)"
FOR_IT = {
    "email": r"(?:e-?mail|mail|contact|kontakt|contacto|courriel|write to|from|cc)[^a-z]*$", "ip": r"(?:\bip\b|host|server|address|adresse|client|login)[^a-z]*$",
    "card": r"(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit)[^a-z]*$", "phone": r"(?:phone|tel|call|mobile|cell|fax|telefon|teléfono|téléphone|whatsapp)[^a-z]*$",
}
AGAINST_IT = r"(?:version|release|section|isbn|issn|order|invoice|token|sha|hash|serial|page|figure|table|no\.|nr\.|id|v)[\s:=#\"']*$"
LABELERS = 5
#: Cells of each kind in the classifier, by feature.
CELLS = {"form": 3, "shape": 64, "before": 8, "after": 8, "word": 128, "digits": 21}
WIDTH = sum(CELLS.values())
ROUNDS = 8
#: Log-odds from which a candidate is added: 99 to one.
SURE = math.log(99)

SPAN = "struct<start:bigint,end:bigint,hit:string,before:string,after:string>"


def _push(s: Column, items: Column, some: Column) -> tuple[Column, Column]:
    """The open chunk and the full ones, with `items` at the end: chunks are short, so appending takes little copying."""
    chunk = F.when(some, F.concat(s["chunk"], items)).otherwise(s["chunk"])
    full = F.size(chunk) >= 64
    return F.when(full, F.slice(chunk, 1, 0)).otherwise(chunk).alias("chunk"), F.when(full, F.concat(s["done"], F.array(chunk))).otherwise(s["done"]).alias("done")


def matches(text: Column, pattern: str, likely: Column) -> Column:
    """All matches in `text`, as SPAN, in code points; before and after are up to 32 characters around, within what is
    between matches. Looked for only in texts that `likely` lets through."""
    none = F.lit(None).cast(SPAN)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("last"), F.array().cast(f"array<{SPAN}>").alias("chunk"), F.array().cast(f"array<array<{SPAN}>>").alias("done"))

    def one(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        end = at + F.coalesce(F.length(x["hit"]), F.lit(0))
        last = s["last"]
        ended = F.struct(last["start"].alias("start"), last["end"].alias("end"), last["hit"].alias("hit"), last["before"].alias("before"), F.left(x["gap"], F.lit(32)).alias("after"))
        new = F.struct(at.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(32)).alias("before"), F.lit("").alias("after"))
        chunk, done = _push(s, F.array(ended), last.isNotNull())
        return F.struct(end.cast("bigint").alias("at"), F.when(x["hit"].isNotNull(), new).otherwise(none).alias("last"), chunk, done)

    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    found = F.aggregate(parts, start, one, lambda s: F.flatten(F.concat(s["done"], F.array(s["chunk"]))))
    return F.when(likely, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def small_parts(hit: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def check(kind: str, hit: Column) -> Column:
    digits = digits_of(hit)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    return {"email": F.lit(True), "ip": small_parts(hit), "phone": F.length(digits).between(9, 15)}[kind]


def _class(c: Column) -> Column:
    """Eight classes of a character next to a span: none, space, stop, bracket, quote, letter, digit, other."""
    tests = [c == "", c.rlike(r"^\s"), c.rlike("^[.,;!?]"), c.rlike(r"^[()\[\]{}<>]"), c.rlike("^[\"'`]"), c.rlike(r"^\p{L}"), c.rlike("^[0-9]")]
    return reduce(lambda rest, x: F.when(x[1], x[0]).otherwise(rest), reversed(list(enumerate(tests))), F.lit(7))


def votes(kind: str, loose: bool, x: Column) -> Column:
    """What each labeler says of a span: 1, 0, or -1 for nothing."""
    digits, low = digits_of(x["hit"]), F.lower(x["before"])
    known = {
        "email": F.when(F.lower(F.regexp_extract(F.right(x["hit"], F.lit(16)), r"([A-Za-z0-9-]+)$", 1)).isin(DOMAIN_ENDS), 1).otherwise(-1),
        "ip": F.when(F.lit(loose), -1).when(x["hit"].rlike(r"^0*(?:0|127|22[4-9]|2[3-9]\d)\.") | ~small_parts(x["hit"]), 0).otherwise(1),
        "card": F.when(digits.rlike(CARD_STARTS), 1).otherwise(0),
        "phone": F.when(F.lit(loose), -1).when(digits.rlike(CALLING), 1).otherwise(0),
    }[kind]
    around = F.when(low.rlike(FOR_IT[kind]), 1).when(low.rlike(AGAINST_IT), 0).otherwise(-1)
    glued = F.right(x["before"], F.lit(1)).rlike(r"[\p{L}0-9=_/\"#]") | x["after"].rlike(r"^[\p{L}0-9=_/\"]")
    sound = F.lit(True) if loose and kind in ("email", "ip") else check(kind, x["hit"])
    return F.array(F.when(sound & F.lit(not loose), 1).otherwise(0), F.when(sound, 1).otherwise(0), known, around, F.when(glued, 0).otherwise(1))


def cells(kind: str, loose: bool, x: Column) -> Column:
    """The classifier's cells that a span falls into, one for each feature."""
    shape = F.left(F.regexp_replace(F.regexp_replace(F.left(x["hit"], F.lit(64)), "[0-9]+", "9"), r"\p{L}+", "a"), F.lit(16))
    word = F.lower(F.regexp_extract(x["before"], r"(\S+)\s*$", 1))
    form = F.lit(2) if loose else F.when(check(kind, x["hit"]), 0).otherwise(1)
    values = {"form": form, "shape": F.pmod(F.xxhash64(shape), F.lit(64)), "before": _class(F.right(x["before"], F.lit(1))), "after": _class(F.left(x["after"], F.lit(1))), "word": F.pmod(F.xxhash64(word), F.lit(128)), "digits": F.least(F.length(digits_of(x["hit"])), F.lit(20))}
    out, at = [], KINDS.index(kind) * WIDTH
    for name, size in CELLS.items():
        out.append((values[name] + at).cast("int"))
        at += size
    return F.array(*out)


def candidates(docs: DataFrame, text_col: str = "text", keep: str = "doc_id") -> DataFrame:
    """(doc_id, found): for each document all base matches and looser ones, as (start, kind, end, base, loose, votes, cells)."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    told = docs.select(quoted(keep).alias("doc_id"), text.alias("text"))
    t, digits = F.col("text"), F.col("text").rlike("[0-9]")
    patterns = {
        ("email", False): (EMAIL, F.contains(t, F.lit("@"))), ("ip", False): (IP, t.rlike(r"[0-9]\.[0-9]++\.[0-9]")), ("card", False): (CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), ("phone", False): (PHONE, F.contains(t, F.lit("+"))),
        ("email", True): (LOOSE_EMAIL, t.rlike(r"[\[({](?:at|AT|@)[\])}]")), ("ip", True): (LOOSE_IP, F.contains(t, F.lit(":")) & digits), ("card", True): (LOOSE_CARD, t.rlike(r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}")), ("phone", True): (LOOSE_PHONE, t.rlike(r"[0-9)][\x20./-][0-9]{3}")),
    }
    names = {key: f"{key[0]}_{int(key[1])}" for key in patterns}
    spans = told.select("doc_id", *(matches(t, *p).alias(names[key]) for key, p in patterns.items()))

    def judged(key: tuple[str, bool]) -> Column:
        kind, loose = key
        base = lambda x: F.lit(False) if loose else check(kind, x["hit"])
        return F.transform(names[key], lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), base(x).alias("base"), F.lit(loose).alias("loose"), votes(kind, loose, x).alias("votes"), cells(kind, loose, x).alias("cells")))

    # no candidates are short failing matches, as year ranges, and looser ones that fail the check
    plausible = lambda x: x["base"] | ((x["end"] - x["start"] >= 7) & ((x["votes"][0] == 1) | (x["votes"][1] == 1) | ~x["loose"]))
    return spans.select("doc_id", F.array_sort(F.filter(F.concat(*map(judged, patterns)), plausible)).alias("found"))


Rates = list[list[float]]


def _odds(prior: list[float], hit: Rates, false: Rates) -> str:
    """SQL: the log-odds of the class 1 for kind and the votes v0 to v4."""
    by_kind = lambda values: "element_at(array(" + ", ".join(f"{v!r}D" for v in values) + "), kind + 1)"
    parts = [by_kind([math.log(p / (1 - p)) for p in prior])]
    for k in range(LABELERS):
        yes = by_kind([math.log(h[k] / f[k]) for h, f in zip(hit, false)])
        no = by_kind([math.log((1 - h[k]) / (1 - f[k])) for h, f in zip(hit, false)])
        parts.append(f"CASE v{k} WHEN 1 THEN {yes} WHEN 0 THEN {no} ELSE 0.0D END")
    return " + ".join(parts)


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[list[float], Rates, Rates]:
    """patterns: kind, v0 to v4, n. By kind: the share of personal data, and how often each labeler that votes says 1 of it
    and of the rest. Priors say that labelers are rather right; without candidates they are what is returned."""
    n = len(KINDS)
    prior, hit, false = [0.5] * n, [[0.8] * LABELERS for _ in range(n)], [[0.2] * LABELERS for _ in range(n)]
    sums = ["sum(q) AS q", "sum(r) AS r"]
    for c in "qr":
        sums += [f"coalesce(sum({c}) FILTER (WHERE v{k} {test}), 0) AS {c}{name}_{k}" for k in range(LABELERS) for name, test in (("1", "= 1"), ("", ">= 0"))]
    for _ in range(rounds):
        told = patterns.withColumn("q", F.expr(f"n / (1 + exp(-({_odds(prior, hit, false)})))")).withColumn("r", F.expr("n - q"))
        for row in told.groupBy("kind").agg(*map(F.expr, sums)).collect():  # a row a kind
            at = row["kind"]
            prior[at] = round((row["q"] + 1) / (row["q"] + row["r"] + 2), 9)
            for k in range(LABELERS):
                hit[at][k] = round((row[f"q1_{k}"] + 8) / (row[f"q_{k}"] + 10), 9)
                false[at][k] = round((row[f"r1_{k}"] + 2) / (row[f"r_{k}"] + 10), 9)
    return prior, hit, false


def train(found: DataFrame, rounds: int = ROUNDS) -> list[float]:
    """The classifier: what each cell adds to the log-odds; the share of a kind is in its first feature."""
    each = found.select(F.explode("found").alias("x")).select("x.kind", *(F.col("x.votes")[k].alias(f"v{k}") for k in range(LABELERS)), "x.cells")
    patterns = materialize(each.groupBy("kind", *(f"v{k}" for k in range(LABELERS))).agg(F.count("*").alias("n")), "votes")
    prior, hit, false = reliabilities(patterns, rounds)
    weighed = each.select(F.explode("cells").alias("cell"), F.expr(f"1 / (1 + exp(-({_odds(prior, hit, false)})))").alias("q"))
    counted = {r["cell"]: (r["yes"], r["n"] - r["yes"]) for r in weighed.groupBy("cell").agg(F.sum("q").alias("yes"), F.count("*").alias("n")).collect()}  # WIDTH cells a kind at most
    weights, at = [], 0
    for _ in KINDS:
        whole = [sum(counted.get(at + k, (0.0, 0.0))[side] for k in range(CELLS["form"])) for side in (0, 1)]
        for name, size in CELLS.items():
            for _ in range(size):
                yes, no = counted.get(at, (0.0, 0.0))
                weight = math.log((yes + 1) / (whole[0] + size)) - math.log((no + 1) / (whole[1] + size))
                weights.append(round(weight + (math.log((whole[0] + 1) / (whole[1] + 1)) if name == "form" else 0.0), 9))
                at += 1
    return weights


def _apart(spans: Column) -> Column:
    """Of spans in order, all base ones and those others that touch neither these nor an earlier one that stays."""
    kind = "struct<start:bigint,kind:int,end:bigint,base:boolean>"
    empty = [F.array().cast(f"array<{kind}>").alias("chunk"), F.array().cast(f"array<array<{kind}>>").alias("done")]
    joined = lambda s: F.flatten(F.concat(s["done"], F.array(s["chunk"])))

    def back(s: Column, x: Column) -> Column:
        chunk, done = _push(s, F.array(x), x["base"] | (x["end"] <= s["next"]))
        return F.struct(F.when(x["base"], F.least(s["next"], x["start"])).otherwise(s["next"]).alias("next"), chunk, done)

    def forth(s: Column, x: Column) -> Column:
        stays = x["base"] | (x["start"] >= s["upto"])
        chunk, done = _push(s, F.array(x), stays)
        return F.struct(F.when(stays, F.greatest(s["upto"], x["end"])).otherwise(s["upto"]).alias("upto"), chunk, done)

    behind = F.aggregate(F.reverse(spans), F.struct(F.lit(2**62).alias("next"), *empty), back, joined)
    return F.aggregate(F.reverse(behind), F.struct(F.lit(0).cast("bigint").alias("upto"), *empty), forth, joined)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the base spans: "kind:start:end" by start, then kind in the order of KINDS, joined by
    commas, in code points with an exclusive end; spans has these and those that the classifier adds. A null text is an empty
    one: no spans, and the digest of an empty string. Repeated rows and null ids are rows of their own; equal texts have equal
    values; texts may be of any length; an empty table gives no rows; further columns are not looked at.
    """
    found = materialize(candidates(docs, text_col, id_col), "private")
    weights = F.array(*map(F.lit, train(found)))
    slim = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))
    odds = lambda x: F.aggregate(x["cells"], F.lit(0.0), lambda s, c: s + F.element_at(weights, c + 1))
    base = F.transform(F.filter("found", lambda x: x["base"]), slim)
    likely = F.transform(F.filter("found", lambda x: x["base"] | (odds(x) >= SURE)), slim)
    seen = found.select(F.col("doc_id").alias(id_col), base.alias("base"), likely.alias("likely"))
    spans = F.when(F.size("base") == F.size("likely"), F.col("base")).otherwise(_apart(F.col("likely")))
    of = lambda k: F.filter("base", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return seen.select(quoted(id_col), *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(spans).alias("spans"))
