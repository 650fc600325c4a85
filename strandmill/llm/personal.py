"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and a
classifier learns from the weighed votes. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, table

#: Fixed values of the contract: the kinds in order and their patterns. A look-behind keeps a long run of the first
#: class from being tried at each of its characters; what is found is the same.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A decimal number of at most 255, with any leading zeros.
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Wider patterns, whose matches are candidates for further spans.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9A-Za-z.-])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z.-])",
}
#: Gazetteers: plain word lists that the labelers look up. Top-level domains, cards' first digits, phones' countries.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "au", "ch", "at", "be", "se", "pl", "pt", "br", "mx", "jp", "cn", "in", "ru")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "65", "35", "36", "38", "30")
COUNTRIES = ("1", "33", "34", "49", "44", "39", "41", "43", "31", "32", "52", "55", "81", "86", "91", "7")
#: Words that announce a kind of data, in the languages of the corpus, and words that announce other numbers.
CUES = {
    "email": ("email", "e-mail", "mail", "mailto", "contact", "correo", "courriel", "kontakt", "write", "reply"),
    "ip": ("ip", "address", "host", "server", "login", "logged", "adresse", "direccion", "client", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "payment", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "sms", "whatsapp", "cell"),
}
AGAINST = ("version", "isbn", "issn", "doi", "order", "invoice", "build", "release", "sku", "part", "model", "serial", "section", "figure")

_NEAR = 40  # characters looked at on either side
_BLOCK = 256  # items of an array that are folded together
_FEATURES = 1024
_ROUNDS = 30
_PRIOR = 10.0  # spans' worth of a feature's usual rate


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefixes(values: Column, op, zero: Column) -> Column:
    """For each item of an array, op over all items before it. In blocks, so that time stays linear for all practical lengths."""
    one = lambda s, v: F.struct(op(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    start = lambda at: F.struct(at.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / _BLOCK).cast("int")), lambda k: F.slice(v, k * _BLOCK + 1, F.lit(_BLOCK)))

    def joined(blocks: Column) -> Column:
        before = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), start(zero), one)["out"]
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.aggregate(b, start(at), one)["out"]))

    return let(let(values, cut), joined)


def _located(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as array<struct(kind, start, end, hit, around)>, in code points.

    The text between matches and the matches give the positions by running sums; around is the match with what lies
    between it and its neighbours of the pattern, _NEAR characters at most on either side.
    """
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,hit:string,around:string>>")

    def spans(hits: Column) -> Column:
        def sided(gaps: Column) -> Column:
            sides = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), F.slice(gaps, 2, F.size(gaps) - 1), lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), F.substring(a, -_NEAR, _NEAR).alias("left"), F.substring(b, 1, _NEAR).alias("right")))
            return F.zip_with(sides, hits, lambda s, h: F.struct(*(s[c].alias(c) for c in ("gap", "left", "right")), h.alias("hit"), F.length(h).cast("long").alias("size")))

        def placed(parts: Column) -> Column:
            begin = prefixes(F.transform(parts, lambda s: s["gap"] + s["size"]), lambda a, v: a + v, F.lit(0).cast("long"))
            return F.zip_with(parts, begin, lambda s, at: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (at + s["gap"]).alias("start"), (at + s["gap"] + s["size"]).alias("end"), s["hit"].alias("hit"), F.concat(s["left"], s["hit"], s["right"]).alias("around")))

        return F.when(F.size(hits) > 0, let(let(F.split(text, pattern, -1), sided), placed)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def apart(spans: Column, others: Column) -> Column:
    """spans that overlap none of others, by start: one sort, and running extremes from either side."""
    mark = lambda side: lambda s: F.struct(s["start"].alias("start"), F.lit(side).alias("side"), s["end"].alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"), s["around"].alias("around"))
    far, zero = F.lit(2**62), F.lit(0).cast("long")

    def kept(every: Column) -> Column:
        ended = prefixes(F.transform(every, lambda s: F.when(s["side"] == 0, s["end"]).otherwise(zero)), lambda a, v: F.greatest(a, v), zero)
        begun = F.reverse(prefixes(F.reverse(F.transform(every, lambda s: F.when(s["side"] == 0, s["start"]).otherwise(far))), lambda a, v: F.least(a, v), far))
        room = F.zip_with(ended, begun, lambda a, b: F.struct(a.alias("ended"), b.alias("begun")))
        good = F.filter(F.zip_with(every, room, lambda s, r: F.struct(s.alias("s"), ((s["side"] == 1) & (r["ended"] <= s["start"]) & (r["begun"] >= s["end"])).alias("ok"))), lambda x: x["ok"])
        return F.transform(good, lambda x: F.struct(*(x["s"][c].alias(c) for c in ("kind", "start", "end", "hit", "around"))))

    return F.when(F.size(spans) > 0, let(F.array_sort(F.concat(F.transform(others, mark(0)), F.transform(spans, mark(1)))), kept)).otherwise(spans)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    return F.call_function("luhn_check", x)


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans of a text that isn't null: array<struct(kind, start, end, hit, around)> by kind, then start."""
    return F.concat(*(_kept(_located(text, BASE[k], k), k) for k in KINDS))


def _kept(spans: Column, kind: str) -> Column:
    return spans if kind == "email" else F.filter(spans, lambda s: _valid(kind, s["hit"]))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, 0 against, null abstains."""
    out = F.when(yes, F.lit(1))
    return out.when(no, F.lit(0)) if no is not None else out


def labelers(kind: Column, hit: Column, around: Column) -> list[Column]:
    """Votes on a candidate: two regular expressions, two gazetteers, two contexts. 1 for, 0 against, null abstains."""
    near = F.lower(around)
    word = lambda words: near.rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")
    by = lambda of: F.coalesce(*(F.when(kind == k, of[name]) for k, name in enumerate(KINDS) if name in of))
    d = digits(hit)
    strict = by({"email": _vote(hit.rlike(r"(?i)^[a-z0-9][a-z0-9._%+-]*[\x20\[(]*(?:@|at)[\x20\])]*[a-z0-9]"), hit.rlike(r"\.\.|^[.-]")), "ip": _vote(hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") | (F.length(hit) >= 15), hit.rlike(r"^0\.|\.0\.0\.0$")), "card": _vote(luhn(d), ~luhn(d)), "phone": _vote(F.length(d).between(10, 15), ~F.length(d).between(7, 15))})
    shape = by({"email": _vote(hit.rlike(r"(?i)[a-z]{2}"), hit.rlike(r"^[0-9@.]+$")), "ip": _vote(~hit.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$"), hit.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$")), "card": _vote(F.length(d).isin(15, 16), ~F.length(d).isin(14, 15, 16, 19)), "phone": _vote(hit.rlike(r"[\x20().-]"), hit.rlike(r"([0-9])\1{6}"))})
    listed = by({"email": _vote(F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)).isin(*DOMAINS)), "card": _vote(hit.rlike("^(?:" + "|".join(ISSUERS) + ")")), "phone": _vote(d.rlike("^(?:" + "|".join(COUNTRIES) + ")")), "ip": _vote(hit.rlike(r"^(?:10|127|172|192)\."))})
    example = by({"email": _vote(F.lit(False), hit.rlike(r"(?i)^(?:noreply|no-reply|postmaster)@")), "ip": _vote(F.lit(False), hit.rlike(r"^(?:0|255)\.")), "card": _vote(F.lit(False), d.rlike(r"^([0-9])\1+$")), "phone": _vote(F.lit(False), d.rlike(r"^([0-9])\1+$"))})
    cue = by({k: _vote(word(CUES[k])) for k in KINDS})
    other = _vote(F.lit(False), word(AGAINST))
    return [strict, shape, listed, example, cue, other]


_LABELERS = 6


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and the spans that only a wider pattern finds: struct(kind, start, end, hit, around)."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("base", base_spans(F.col("text")))
    wide = F.concat(*(_located(F.col("text"), WIDE[k], k) for k in KINDS))
    return d.select("doc_id", let(F.struct(F.col("base").alias("base"), wide.alias("wide")), lambda s: F.struct(s["base"].alias("base"), apart(s["wide"], s["base"]).alias("wide"))).alias("s")).select("doc_id", "s.base", "s.wide")


def _pattern(votes: list[Column]) -> Column:
    """Votes as digits: 0 against, 1 for, 2 abstains."""
    return F.concat(*(F.coalesce(v.cast("string"), F.lit("2")) for v in votes))


def reliabilities(counts: dict[tuple[int, str], int], rounds: int = _ROUNDS) -> dict[tuple[int, str], float]:
    """Probability that each pattern of votes is personal data, by expectation-maximisation for each kind.

    counts: (kind, pattern) to rows, at most 3**6 patterns a kind for any size of input. Two classes; each labeler has a
    chance to vote for in each, and abstaining says nothing. Prior votes worth a tenth of the rows take a labeler to be
    right four times in five, which keeps the two classes from changing places where all labelers agree.
    """
    out: dict[tuple[int, str], float] = {}
    for kind in sorted({k for k, _ in counts}):
        rows = sorted((p, n) for (k, p), n in counts.items() if k == kind)
        post = {p: (1 + p.count("1")) / (2 + p.count("1") + p.count("0")) for p, _ in rows}
        total = sum(n for _, n in rows)
        extra = 1 + total / 10
        for _ in range(rounds):
            prior = (1 + sum(n * post[p] for p, n in rows)) / (2 + total)
            logs = []  # for each class and labeler: of a vote against, a vote for, and none
            for c in (0, 1):
                logs.append([])
                for j in range(_LABELERS):
                    vote = [extra * (0.2 if c else 0.8), extra * (0.8 if c else 0.2)]
                    for p, n in rows:
                        if p[j] != "2":
                            vote[int(p[j])] += n * (post[p] if c else 1 - post[p])
                    logs[c].append([*(math.log(x / sum(vote)) for x in vote), 0.0])
            for p, _ in rows:
                yes, no = (math.log(x) + sum(logs[c][j][int(v)] for j, v in enumerate(p)) for c, x in ((1, prior), (0, 1 - prior)))
                post[p] = 1 / (1 + math.exp(min(700.0, no - yes)))
        out |= {(kind, p): x for p, x in post.items()}
    return out


def features(span: Column) -> Column:
    """Hashed features of a span: its shape, length and the words on either side, as an array of places."""
    hit, around = span["hit"], span["around"]
    shape = F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "9"), r"[\p{L}]+", "a")
    words = F.slice(F.split(F.lower(F.regexp_replace(around, r"[^\p{L}]+", " ")), " "), 1, 12)
    raw = F.concat(F.array(F.concat(F.lit("s"), shape), F.concat(F.lit("n"), F.length(hit).cast("string"))), F.transform(words, lambda w: F.concat(F.lit("w"), w)))
    return F.array_distinct(F.transform(raw, lambda x: F.pmod(F.xxhash64(span["kind"], x), F.lit(_FEATURES)).cast("int")))


def train(rows: DataFrame, chance: Column) -> list[float]:
    """Weights of a naive Bayes classifier over hashed features, from soft labels; one number a place, then the prior.

    Soft labels are rounded to millionths and added as integers, so that the sums don't depend on their order; the
    driver gets at most as many rows as there are places.
    """
    d = rows.select(F.round(chance * 1_000_000).cast("long").alias("p"), features(F.col("span")).alias("f"))
    got = d.select("p", F.explode(F.concat("f", F.array(F.lit(_FEATURES)))).alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(F.lit(1_000_000) - F.col("p")).alias("no")).collect()
    by = {r["f"]: (r["yes"] / 1e6, r["no"] / 1e6) for r in got}
    yes, no = by.get(_FEATURES, (0.0, 0.0))
    weights = [0.0] * _FEATURES
    for k, (a, b) in by.items():
        if k < _FEATURES and a + b > 0:  # each class's rate, drawn towards that of both
            usual = (a + b) / (yes + no)
            weights[k] = math.log((a + _PRIOR * usual) / (yes + _PRIOR)) - math.log((b + _PRIOR * usual) / (no + _PRIOR))
    return [*weights, math.log((yes + 1) / (no + 1))]


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, base and added spans, each array<struct(kind, start, end, hit)>.

    A null or empty text has none. Positions are code points, the end exclusive. Base spans follow fixed patterns and
    always stay. Further candidates come from wider patterns and must not touch a base span; labelers vote on base and
    further candidates alike, and a further one becomes a span if the classifier gives it the threshold. Without
    candidates nothing is learned or added. Repeated rows are reported each; very long texts are scanned whole, in time linear
    in their length; an empty table gives no rows; other columns are not read.

    The text is scanned once; spans with their surroundings are kept in the shared folder. The driver gets counts of
    vote patterns and of hashed features, whose number is fixed.
    """
    found = save(candidates(docs), "spans")
    spans = found.select(F.explode(F.concat("base", "wide")).alias("span"))
    votes = _pattern(labelers(F.col("span.kind"), F.col("span.hit"), F.col("span.around")))
    voted = spans.select("span", votes.alias("votes"))
    counts = {(r["kind"], r["votes"]): r["count"] for r in voted.groupBy(F.col("span.kind").alias("kind"), "votes").count().collect()}
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,hit:string,around:string>>")
    added = none
    if counts:
        known = reliabilities(counts)
        chances = F.create_map(*(x for (k, p), c in sorted(known.items()) for x in (F.lit(f"{k}:{p}"), F.lit(c))))
        weights = train(voted, chances[F.concat(F.col("span.kind").cast("string"), F.lit(":"), F.col("votes"))])
        learned = F.array(*(F.lit(float(w)) for w in weights))
        score = lambda s: F.aggregate(features(s), F.lit(weights[-1]), lambda a, f: a + F.element_at(learned, f + 1))
        added = F.filter("wide", lambda s: score(s) > math.log(threshold / (1 - threshold)))
    bare = lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "hit")))
    return found.select("doc_id", F.transform("base", bare).alias("base"), F.transform(added, bare).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    d = find_personal_data(table(spark, sf_dir, "documents"))
    n = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return d.select("doc_id", *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
