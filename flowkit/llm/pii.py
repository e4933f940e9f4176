"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans: the strict forms, whose rules give the base spans, loose forms of the
same kinds, and secrets. Gradient-boosted trees of depth two score each span by its format and its context. They are
fitted on the spans of all documents. Labels are the strict rules' verdicts; strict spans rewritten to loose forms, in their own
contexts; for loose spans found in the text, whether the value also occurs in strict form or the words before name the
kind. A threshold per kind, calibrated on held-out spans, selects what is added to the base spans, which always stay; of
added spans that overlap, the best score stays.

Everything is DataFrame expressions: candidates are cut out with regular expressions, their places are running sums, the
trees are fitted by aggregates over binary features and applied as conditional sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint, text_of

#: Kinds in the order in which spans that start together are listed. Base spans are of the first four.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Trees, learning rate, smallest Hessian sum of a leaf, precision that a kind's added spans must reach, and how many
#: held-out spans the model's own odds weigh; gradients are summed in whole parts of 1 / UNIT.
TREES, RATE, LEAST_LEAF, PRECISION, PRIOR_SPANS, UNIT = 16, 0.5, 0.5, 0.9, 0.5, 1 << 20

# Quantifiers are possessive and starts are tied to the run's start or the last match's end, so that long runs of one
# character class cost linear time and no recursion; the matches are those of the plain patterns.
_EMAIL_CHAR = "A-Za-z0-9._%+-"
GENERATORS = (
    ("email", rf"(?:(?<![{_EMAIL_CHAR}])|\G)[{_EMAIL_CHAR}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", rf"(?:(?<![{_EMAIL_CHAR}])|\G)[{_EMAIL_CHAR}]++(?:\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?|\x20at\x20)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++|\x20?(?:\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++|\x20dot\x20[A-Za-z0-9-]++)++"),
    ("ip", r"(?:(?<![0-9A-Fa-f:])|\G)(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{3,7}){2,3}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20./-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"),
    ("secret", r"(?:(?<![A-Za-z0-9_+/-])|\G)(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}"),
)
_STRICT = len(BASE)
#: A text without a match of this has none of the generator's.
_NEEDS = ("@", "[0-9]", "[0-9]", r"\+", r"[(\[{\x20]at[)\]}\x20]", ":", "[0-9][./_][0-9]", "[0-9]", "[A-Za-z0-9_+/-]{20}")

#: Words before a span that name its kind, and what stands before a secret.
_SAID = {"email": "mail|contact|write", "ip": "host|server|addr|ip|node", "card": "card|visa|account|payment", "phone": "tel|phone|call|mobile|fax", "secret": "token|secret|passw|pwd|key|auth|bearer"}
FEATURES = (
    "len >= 7", "len >= 10", "len >= 14", "len >= 19", "len >= 32", "digits >= 4", "digits >= 8", "digits >= 10", "digits >= 12", "digits >= 16",
    "groups >= 2", "groups >= 3", "groups >= 4", "groups >= 6", "longest >= 4", "longest >= 5", "longest >= 8", "instr(match, '@') > 0", "left(match, 1) = '+'", "left(match, 2) = '00'", "instr(match, '(') > 0",
    "instr(match, '.') > 0", "instr(match, '-') > 0", "instr(match, '/') > 0", "instr(match, ' ') > 0", "match rlike '[A-Za-z]'", "match rlike '[.][A-Za-z]{2,6}$'", "match rlike '[(\\\\[{]at[)\\\\]}]'",
    "colons = 7", "colons = 5", "luhn", "small", "match rlike '^[0-9a-f]+$'", "match rlike '[A-Z]' and match rlike '[a-z]'",
    "before rlike '[0-9A-Za-z]$'", "before rlike '[.+-]$'", "before rlike '[=:] ?[\"\\']?$'", "after rlike '^[0-9A-Za-z]'", "after rlike '^[.@-][0-9A-Za-z]'",
    *(f"lower(before) rlike '{words}'" for words in _SAID.values()), *(f"kind = '{k}'" for k in KINDS),
)
_CONTEXT = 24


def _candidates(text: Column) -> Column:
    """All matches of all generators: generator, nth, gap (code points since the last match), match, before, after."""
    def of(g: int) -> Column:
        hint = text.rlike(_NEEDS[g])
        none = F.array().cast("array<string>")
        matches = F.when(hint, F.regexp_extract_all(text, F.lit(GENERATORS[g][1]), 0)).otherwise(none)
        gaps = F.when(F.size(matches) > 0, F.split(text, GENERATORS[g][1], -1)).otherwise(none)
        both = F.arrays_zip(matches.alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))).alias("n"))

        def cut(x: Column, i: Column) -> Column:
            around = (F.right(x["g"], F.lit(_CONTEXT)).alias("before"), F.left(x["n"], F.lit(_CONTEXT)).alias("after"))
            return F.struct(F.lit(g).alias("generator"), i.alias("nth"), F.char_length(x["g"]).alias("gap"), x["m"].alias("match"), *around)

        return F.transform(both, cut)

    arrays = [of(g) for g in range(len(GENERATORS))]
    return F.filter(F.concat(*arrays), lambda x: x["match"].isNotNull())


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum is divisible by 10."""
    n = F.char_length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, n - i + 1, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(F.when(n > 0, each).otherwise(F.array(F.lit(1))), F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _card() -> Column:
    """Whether the match has 12 to 19 digits that pass Luhn."""
    n = F.char_length(_digits())
    return F.when(n.between(12, 19), _luhn(F.when(n.between(12, 19), _digits()).otherwise("0"))).otherwise(False)


def _small() -> Column:
    """Whether the match is four numbers of at most 255."""
    number = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return F.col("match").rlike(rf"^{number}(?:\.{number}){{3}}$")


def _valid() -> Column:
    """Whether a match of a strict generator passes its rule; false for the others."""
    g = F.col("generator")
    return F.when(g == 0, True).when(g == 1, _small()).when(g == 2, _card()).when(g == 3, F.char_length(_digits()).between(9, 15)).otherwise(False)


def _spread(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs in as many tasks as the session has cores at least: patterns cost far more
    than the move of a text. Input that already lies in so many tasks, as any large one does, stays where it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    held = docs.select(F.spark_partition_id().alias("task")).distinct().count()  # reads no column
    out = docs.select("doc_id", "text")
    return out.repartition(cores) if held < cores else out


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: row, doc_id, kind, strict, start, end, match, before, after and valid; and a row of nulls for
    every document. Places count code points, the end is exclusive."""
    rows = docs.select("doc_id", text_of().alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", _candidates(F.col("text")).alias("found"))
    none = F.array(F.when(F.lit(False), F.get("found", F.lit(0))))
    rows = rows.select("row", "doc_id", F.explode(F.concat("found", none)).alias("x")).select("row", "doc_id", "x.*")
    rows = rows.repartition("row")  # serves the places and the runs
    # every generator's places are running sums over its own matches in one document
    places = Window.partitionBy("row", "generator").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("match")
    rows = rows.withColumn("end", F.sum(F.col("gap") + n).over(places)).withColumn("start", F.col("end") - n)
    kinds = F.array(*[F.lit(k) for k, _ in GENERATORS])
    rows = rows.withColumns({"kind": F.element_at(kinds, F.col("generator") + 1), "valid": _valid()})
    return rows.select("row", "doc_id", "generator", "kind", "start", "end", "match", "before", "after", "valid")


def _with_features(rows: DataFrame) -> DataFrame:
    groups = F.split("match", "[^0-9]+")
    rows = rows.withColumns({"len": F.char_length("match"), "digits": F.char_length(_digits()), "groups": F.size(F.filter(groups, lambda g: g != "")), "longest": F.array_max(F.transform(groups, F.char_length))})
    rows = rows.withColumns({"colons": F.size(F.split("match", ":")) - 1, "luhn": _card(), "small": _small()})
    rows = rows.withColumns({f"f{k}": F.expr(f"coalesce({x}, false)") for k, x in enumerate(FEATURES)})
    return rows.drop("len", "digits", "groups", "longest", "colons", "luhn", "small")


@dataclass
class Boosted:
    """prior, then trees (first feature, feature if it holds, feature if not, four values); a threshold for each kind."""

    prior: float = -20.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(self.prior)
        for a, b, c, (v11, v10, v01, v00) in self.trees:
            total = total + F.when(F.col(f"f{a}"), F.when(F.col(f"f{b}"), v11).otherwise(v10)).otherwise(F.when(F.col(f"f{c}"), v01).otherwise(v00))
        return total

    def accepts(self) -> Column:
        """Whether the score reaches its kind's threshold; a kind without one accepts nothing."""
        out = F.lit(False)
        for kind, t in self.thresholds.items():
            out = F.when(F.col("kind") == kind, F.round("score", 2) >= t).otherwise(out)
        return out


def _gain(g: float, h: float) -> float:
    return g * g / (h + 1.0)


def fit(rows: DataFrame, trees: int = TREES) -> Boosted:
    """Fit on labelled candidates (features f0.. and valid), a fifth of them held out for the thresholds.

    Candidates with the same features and label count together. Each split is chosen from gradient sums by feature, which
    Spark aggregates; only those few sums reach the driver. Without candidates no kind gets a threshold.
    """
    width = len(FEATURES)
    held = F.pmod(F.xxhash64("match", "before"), F.lit(5)) == 0
    alike = rows.groupBy(held.alias("held"), "kind", *[f"f{k}" for k in range(width)]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("valid").cast("int")).alias("k"))
    alike = checkpoint(alike.coalesce(rows.sparkSession.sparkContext.defaultParallelism))  # a row for each pattern of features
    train = alike.where("not held").withColumn("on", F.array_compact(F.array(*[F.when(F.col(f"f{k}"), F.lit(k)) for k in range(width)])))
    seen = train.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    model = Boosted()
    if not seen["n"]:
        return model
    model.prior = math.log((seen["k"] + 0.5) / (seen["n"] - seen["k"] + 0.5))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.score()))
        now = train.withColumns({"g": F.col("k") - F.col("n") * p, "h": F.col("n") * p * (1 - p)})
        now = now.withColumns({c: F.round(F.col(c) * UNIT).cast("long") for c in "gh"})  # whole numbers: sums in any order agree

        def sums(where: Column, now=now) -> dict:
            """side -> feature -> gradient and Hessian sums of the rows that have it; None stands for all rows."""
            each = now.select(where.alias("side"), "g", "h", F.explode(F.concat(F.array(F.lit(-1)), "on")).alias("f"))
            out: dict = {True: {}, False: {}}
            for r in each.groupBy("side", "f").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                out[r["side"]][r["f"]] = (r["g"] / UNIT, r["h"] / UNIT)
            return out

        def best(x: dict) -> tuple[int, tuple, tuple]:
            (all_g, all_h), split = x.get(-1, (0.0, 0.0)), []
            for k in range(width):
                g, h = x.get(k, (0.0, 0.0))
                fair = min(h, all_h - h) >= LEAST_LEAF
                split.append((_gain(g, h) + _gain(all_g - g, all_h - h) if fair else -1.0, -k, (g, h), (all_g - g, all_h - h)))
            _, k, yes, no = max(split)
            return -k, yes, no

        first, *_ = best(sums(F.lit(True))[True])
        sides = sums(F.col(f"f{first}"))
        b, *yes = best(sides[True])
        c, *no = best(sides[False])
        model.trees.append((first, b, c, tuple(round(RATE * g / (h + 1.0), 9) for g, h in (*yes, *no))))
    model.thresholds = _thresholds(alike.withColumn("score", F.round(model.score(), 2)))
    return model


def _thresholds(rows: DataFrame) -> dict[str, float]:
    """By kind the least score from which on a span is right with PRECISION.

    Precision by score is isotonic regression over the kind's held-out spans; at each score the model's own odds weigh as
    PRIOR_SPANS spans. So a kind with few of them still gets a threshold, and one with many goes by what they show.
    """
    odds = 1 / (1 + F.exp(-F.col("score")))
    seen = rows.groupBy("kind", "score").agg(F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("held"), F.col("k")).otherwise(0)).alias("k"), F.max(odds).alias("p"))
    steps: dict[str, list[list[float]]] = {}
    for r in seen.orderBy(F.desc("score")).collect():
        own = steps.setdefault(r["kind"], [])
        own.append([r["k"] + PRIOR_SPANS * r["p"], r["n"] + PRIOR_SPANS, r["score"]])
        while len(own) > 1 and own[-1][0] * own[-2][1] >= own[-2][0] * own[-1][1]:  # a lower score may not be right more often
            k, n, score = own.pop()
            own[-1] = [own[-1][0] + k, own[-1][1] + n, score]
    good = {kind: [score for k, n, score in own if k >= PRECISION * n] for kind, own in steps.items()}
    return {kind: min(x) for kind, x in good.items() if x}


def _value() -> Column:
    """What a span says in whatever form: an address in lower case, a card's digits, a phone's last nine digits."""
    plain = F.regexp_replace(F.regexp_replace(F.lower("match"), r"\x20?[(\[{]at[)\]}]\x20?|\x20at\x20", "@"), r"\x20?[(\[]dot[)\]]\x20?|\x20dot\x20", ".")
    return F.when(F.col("kind") == "email", plain).when(F.col("kind") == "card", _digits()).when(F.col("kind") == "phone", F.right(_digits(), F.lit(9))).otherwise(F.col("match"))


def _rewritten(rows: DataFrame) -> DataFrame:
    """Strict candidates in loose forms, with their contexts and labels."""
    m, kind = F.col("match"), F.col("kind")
    user, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    hexes = F.transform(F.split(m, r"\."), lambda x: F.lower(F.hex(x.cast("long"))))
    email = F.array(F.concat(user, F.lit(" (at) "), domain), F.concat(user, F.lit("[at]"), F.regexp_replace(domain, r"\.", " [dot] ")), F.concat(user, F.lit(" at "), domain))
    ip = F.array(F.concat(F.lit("2001:db8:0:1:"), F.array_join(hexes, ":")), F.concat(F.lit("fe80:0:0:0:"), F.array_join(F.transform(hexes, lambda x: F.lpad(x, 4, "0")), ":")))
    fours = [F.nullif(F.substr(_digits(), F.lit(4 * k + 1), F.lit(4 if k < 3 else 7)), F.lit("")) for k in range(4)]
    card = F.array(*[F.concat_ws(x, *fours) for x in "./_"])
    own = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]", "")
    phone = F.array(F.concat(F.lit("00"), F.substr(m, F.lit(2), F.char_length(m))), own, F.regexp_replace(F.regexp_replace(own, "[()]", ""), r"\x20", "-"))
    forms = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)
    mac = rows.where((kind == "ip") & F.col("valid")).withColumns({"match": F.concat(F.lit("08:00:"), F.array_join(F.transform(hexes, lambda x: F.lpad(x, 2, "0")), ":")), "valid": F.lit(False)})
    loose = rows.where(F.col("valid") | (kind == "card") & F.char_length(_digits()).between(12, 19)).withColumn("match", F.explode(forms))
    return loose.unionByName(mac)


def train(docs: DataFrame) -> Boosted:
    """Fit on the candidates in all documents."""
    return _fitted(_held(docs))


def _held(docs: DataFrame) -> DataFrame:
    """Candidates of all documents with their runs and, a bit each, their features: found once, for training and for scoring.
    Every document is a row of nulls, too."""
    rows = _with_features(_runs(candidates(_spread(docs))))
    bits = reduce(Column.bitwiseOR, [F.when(F.col(f"f{k}"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(len(FEATURES))])
    return checkpoint(rows.withColumn("bits", bits).drop(*[f"f{k}" for k in range(len(FEATURES))]))


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"f{k}": F.col("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0 for k in range(len(FEATURES))}).drop("bits")


def _fitted(held: DataFrame) -> Boosted:
    found = held.where(F.col("match").isNotNull())
    columns = ["kind", "match", "before", "after", "valid", "bits"]
    strict = found.where(F.col("generator") < _STRICT).select(*columns)
    known = strict.where("valid").select("kind", _value().alias("value"), F.lit(True).alias("known")).distinct()
    said = F.lit(False)
    for kind, words in _SAID.items():
        said = F.when(F.col("kind") == kind, F.lower("before").rlike(rf"(?:{words})[a-z]*[^0-9A-Za-z]{{0,6}}$")).otherwise(said)
    # a loose form inside a base span says nothing of its own kind
    loose = found.where((F.col("generator") >= _STRICT) & ~F.array_contains("base_kinds", F.col("kind"))).withColumn("value", _value())
    loose = loose.join(known, ["kind", "value"], "left")
    told = F.coalesce("known", F.lit(False)) | said
    # of forms that hardly anything else has, those that nothing tells of are left out; of the others they count as wrong
    rare = F.when(F.col("kind") == "email", F.col("match").rlike("[A-Za-z]{2}$"))
    rare = rare.when(F.col("kind") == "phone", F.col("match").rlike(r"^00|\(|^[0-9]{3}-[0-9]{3}-[0-9]{4}$")).otherwise((F.col("kind") == "ip") & (F.size(F.split("match", ":")) == 8))
    label = F.when(F.size("base_kinds") > 0, False).when(F.col("kind") == "card", _card()).when(told, True).when(~rare, False)
    loose = loose.withColumn("valid", label).where(F.col("valid").isNotNull()).select(*columns)
    return fit(_unpacked(strict.unionByName(loose)).unionByName(_with_features(_rewritten(strict.drop("bits")))))


def _runs(rows: DataFrame) -> DataFrame:
    """Adds run, the number in the document of each run of overlapping spans, and base_kinds, kinds of base spans in it."""
    upto = Window.partitionBy("row").orderBy("start", "end", "generator")
    before = F.max("end").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.when(F.col("start") < before, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("run").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("base_kinds", F.collect_set(F.when(F.col("valid"), F.col("kind"))).over(Window.partitionBy("row", "run")))


def _is(k: int):
    return lambda x: x == k


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret and n_spans (all) of every row.

    The first four counts and the digest are those of base spans. Null texts count as empty; a text without spans has zero
    counts, an empty list and the digest of an empty list. Base spans of different kinds may overlap and all stay; an added
    span overlaps no other span. Repeated rows give rows each; other columns are ignored.
    """
    held = _held(docs)
    model = model or _fitted(held)
    rows = _unpacked(held.drop("run", "base_kinds")).withColumn("score", model.score())
    rows = rows.where(F.col("match").isNull() | F.col("valid") | (F.col("generator") >= _STRICT) & model.accepts())
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    rows = _runs(rows.select("row", "doc_id", "generator", "kind", "start", "end", "valid", "score", F.struct(F.col("start"), kind.alias("k"), F.col("end")).alias("span")))
    best = F.row_number().over(Window.partitionBy("row", "run").orderBy(F.desc("valid"), F.desc("score"), "start", "end", "generator")) == 1
    rows = rows.withColumn("more", F.col("start").isNotNull() & ~F.col("valid") & best)
    found = rows.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("valid"), F.col("span")))).alias("base"), F.collect_list(F.when(F.col("more"), F.col("span"))).alias("more"))
    counts = [F.size(F.filter("base.k", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    every = F.array_sort(F.concat("base", "more"))
    secrets = F.size(F.filter("more.k", _is(len(BASE)))).cast("long").alias("n_secret")
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"), secrets, F.size(every).cast("long").alias("n_spans"))


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with every found span replaced by its kind in brackets, in a column redacted. Overlapping spans become one."""
    spans = find_personal_data(docs, model).select(F.col("doc_id").alias("__id"), "spans").dropDuplicates(["__id"])
    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    parts = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    text = text_of()
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        start, end = s[1].cast("int"), s[2].cast("int")
        out = F.when(start < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(text, a["at"] + 1, start - a["at"]), F.lit("["), s[0], F.lit("]")))
        return F.struct(out.alias("out"), F.greatest(a["at"], end).alias("at"))

    joined = F.aggregate(parts, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.char_length(text))))
    return rows.withColumn("redacted", F.coalesce(joined, text)).drop("spans")
