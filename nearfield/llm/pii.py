r"""Personal data: overlapping candidate spans, scored by boosted trees, in DataFrame expressions only.

1. Base patterns, one for each kind, give spans that always stay (`base_spans`).
2. High-recall generators propose further spans: the same kinds written with other separators,
   without a plus sign, or with spelled-out signs (`candidates`). They overlap freely.
3. Proposals that overlap a base span or fail the check of their kind (Luhn, parts of an address,
   number of digits) go. Gradient-boosted trees over the format of the others and their context score
   them. They are fitted on a table labelled by hand: wide forms in contexts where they are personal
   data, the same forms in contexts where they aren't, and look-alikes (`FORMS` and below). The fitted
   trees become one Spark expression: a sum of CASE expressions.
4. A threshold calibrated on the table's held-out half for a wanted precision selects spans; of
   overlapping proposals the one of the highest score is taken, and none that overlaps a base span.

Scanning is linear in the text: lookbehinds and possessive quantifiers start a match only where a run
of its characters begins, which finds what the plain patterns find, leftmost and without overlaps.

Defined results: null and empty texts have no spans; offsets count code points, ends are exclusive;
equal rows get equal spans; a null or repeated doc_id changes nothing, as rows are judged one by one;
an empty table gives an empty result.
Columns other than those to keep and the text are not read.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import packed, table, unpacked

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap patterns that a text must hold to hold a base span of the kind,
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){2}", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}+){3}+(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?<![0-9][ ./_-])[0-9](?:[ ./_-]{0,2}+[0-9]){13,18}+(?![ ./_-]{0,2}[0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][ ().-])(?:\+|00)?[(]?[0-9](?:[ ().-]{0,2}+[0-9]){9,14}+(?![ ().-]{0,2}[0-9])",
}
#: and to hold a wide one.
WIDE_NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9] ?[.(\[]", "card": "(?:[0-9][ ./_-]{0,2}){13}[0-9]", "phone": "(?:[0-9][ ().-]{0,2}){9}[0-9]"}
CONTEXT = 24
CHUNK = 256
#: The labelled table. Wide forms of each kind:
FORMS = {
    "email": ["john (at) example (dot) com", "jane.roe [at] corp [dot] org", "max(at)site.net", "a-b [at] mail.example.com", "info (at) shop (dot) co (dot) uk", "k_lee(at)uni(dot)edu", "sam @ firm.de", "pat@ web.org"],
    "ip": ["192[.]168[.]1[.]10", "10[.]0[.]0[.]1", "8(.)8(.)8(.)8", "172.16.254[.]3", "203.0[.]113.77", "198[.]51[.]100[.]23"],
    "card": ["4111.1111.1111.1111", "4111_1111_1111_1111", "5555/5555/5555/4444", "4012  8888  8888  1881", "6011.1111.1111.1117", "3782_822463_10005", "5105.1051.0510.5100", "3714.496353.98431"],
    "phone": ["(555) 123-4567", "555-123-4567", "555.123.4567", "555 123 4567", "1 555 123 4567", "1-212-555-0187", "0044 20 7946 0958", "020 7946 0958", "0049 30 901820", "(020) 7946 0018", "00 33 1 42 68 53 00"],
}
#: contexts in which they are personal data,
_SAID = ["write to {} today", "{}", "reach me under {} or by post", "from {} yesterday", "It is {} as always"]
CONTEXTS = {
    "email": [*_SAID, "mail: {}", "contact {} for more", "my address is {}"],
    "ip": [*_SAID, "server {} was down", "blocked host {} again", "addr={} port 80"],
    "card": [*_SAID, "card {} was charged", "Visa: {}", "paid with {} on Monday"],
    "phone": [*_SAID, "call {} after six", "phone: {}", "Tel. {}", "mobile {}, evenings", "fax {}"],
}
#: and contexts in which something else is written that way;
_NAMED = ["version {}", "order {} was sent", "serial {}", "part {}", "sku={}", "token {}"]
OTHERWISE = {"email": [], "ip": _NAMED, "card": [*_NAMED, "id {} in the list"], "phone": [*_NAMED, "id {} in the list", "isbn {}", "doi {}"]}
#: look-alikes, anywhere.
ALIKE = [
    "978-3-16-148410-0", "0-306-40615-2-11", "2024-01-15 10:20", "2023-11-05 12:30:01", "1999.12.31 23:59", "1700000000", "1699999999123", "100 200 300 4000", "1 2 3 4 5 6 7 8 9 10", "10-20-30-40-50", "3.14159265358979", "12345678901", "0000000000", "20240115 093000", "1990-2000 2010-2020", "2001 2002 2003 2004", "10.1000 182 3456",
    "1 . 2 . 3 . 4", "1. 2. 3. 4", "4 .2 .1 .9", "5. 6. 7. 8", "7 . 0 . 12 . 1",
    "met @ noon. then", "two @ 5.00 each", "sold @ 12.50", "be (at) home. later", "dinner @ eight. bring", "left @ dawn. nobody", "stay [at] work. today",
    "4111111111.111111", "00000000000000.00", "1111 2222 3333 4444 5", "0000_0000_0000_0000",
]
ANYWHERE = [*_SAID, "see {} below", "on {} we left", "total {} units", "call {} times"]
SPAN = "struct<start:int,end:int,found:string>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    d = digits(x)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(d, i, F.lit(1))) - 48
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when((n - i) % 2 == 0, digit).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def passes(kind: str, x: Column) -> Column:
    """The check of a base match."""
    n = F.length(digits(x))
    if kind == "ip":

        def small(part: Column) -> Column:
            bare = F.ltrim(part, F.lit("0"))
            return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(x, r"\."), small)
    return {"email": F.lit(True), "card": n.between(14, 19) & luhn(x), "phone": n.between(10, 15)}[kind]


def _once(x: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def located(text: Column, pattern: str, needs: str) -> Column:
    """All matches of a pattern in a text as an array of SPAN, by their lengths and those of the gaps between them.

    Matches are placed within chunks first, then chunks within the text, so that the cost stays in line with their number.
    """
    none = F.array().cast(f"array<{SPAN}>")
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gap"))

    def step(so_far: Column, pair: Column) -> Column:
        begin = so_far["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["found"])
        return F.struct(end.alias("at"), F.array_append(so_far["spans"], F.struct(begin.alias("start"), end.alias("end"), pair["found"].alias("found"))).alias("spans"))

    def chunks(matches: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(matches, c * CHUNK + 1, F.lit(CHUNK)), start, step))

    def moved(parts: Column) -> Column:
        begins = F.aggregate(parts, F.array(F.lit(0)), lambda b, p: F.array_append(b, F.element_at(b, -1) + p["at"]))
        by_chunk = F.arrays_zip(parts.alias("part"), _once(begins, lambda b: F.slice(b, F.lit(1), F.size(b) - 1)).alias("at"))
        return F.flatten(F.transform(by_chunk, lambda x: F.transform(x["part"]["spans"], lambda s: F.struct((s["start"] + x["at"]).alias("start"), (s["end"] + x["at"]).alias("end"), s["found"].alias("found")))))

    spans = _once(F.filter(pairs, lambda p: p["found"].isNotNull()), lambda m: F.when(F.size(m) > 0, _once(chunks(m), moved)).otherwise(none))
    return F.coalesce(F.when(text.rlike(needs) & text.rlike(pattern), spans), none)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _base_<kind>, the checked spans of each base pattern."""

    def of(kind: str) -> Column:
        return F.filter(located(F.col(text), BASE[kind], NEEDS[kind]), lambda s: passes(kind, s["found"]))

    return docs.withColumns({f"_base_{k}": of(k) for k in KINDS})


def _features(kind: Column, text: Column, c: Column) -> dict[str, Column]:
    """What the trees see of a candidate of a text."""
    found, n = c["found"], F.length(c["found"])
    before = F.substring(text, F.greatest(c["start"] - CONTEXT + 1, F.lit(1)), F.least(c["start"], F.lit(CONTEXT)))
    after = F.substring(text, c["end"] + 1, F.lit(2))
    yes = lambda x: x.cast("int").cast("double")
    count = lambda pattern: (n - F.length(F.regexp_replace(found, pattern, ""))).cast("double")
    out = {f"is_{k}": yes(kind == k) for k in KINDS}
    out |= {
        "length": n.cast("double"), "digits": count("[0-9]"), "blanks": count("[ ]"), "dots": count("[.]"), "dashes": count("[-]"), "others": count("[^A-Za-z0-9 .-]"), "plus": yes(found.startswith("+")), "year_first": yes(found.rlike("^(19|20)[0-9]{2}([^0-9]|$)")), "letters_after_dot": yes(found.rlike("[A-Za-z0-9][.][a-z]{2,}$")),
        "zero_first": yes(found.rlike("^[(]?0")), "even_groups": yes(found.rlike("^[0-9]{4}([^0-9]?[0-9]{4}){3}$")), "three_three_four": yes(found.rlike("[0-9]{3}[^0-9]+[0-9]{3}[^0-9]+[0-9]{4}$")), "at_sign": yes(F.contains(found, F.lit("@"))),
        "word_before": yes(before.rlike("[A-Za-z0-9]$")), "sign_before": yes(before.rlike("[=#$/_:,.-]$")), "word_after": yes(after.rlike("^[A-Za-z0-9]")), "sign_after": yes(after.rlike("^[./:_-][A-Za-z0-9]")),
        "named_before": yes(before.rlike("(?i)(mail|phone|call|tel|fax|card|visa|host|addr|server|contact|mobile)[^A-Za-z]*$")), "other_name_before": yes(before.rlike("(?i)(version|isbn|doi|serial|order|part|sku|token|id|no)[^A-Za-z]*$")),
    }
    return out


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _proposed, the array of all generators' spans with their kinds; they may overlap each other and base spans."""
    def of(kind: str) -> Column:
        return F.transform(located(F.col(text), WIDE[kind], WIDE_NEEDS[kind]), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))

    return docs.withColumn("_proposed", F.concat(*map(of, KINDS)))


@dataclasses.dataclass(frozen=True)
class Model:
    """bias and trees: (feature, threshold, low branch, high branch) or a leaf's value; a score selects from the threshold on."""

    bias: float
    trees: list
    threshold: float


def _tree(x: dict[str, np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float):
    leaf = rate * float(gradient.sum() / (hessian.sum() + 1.0))
    best = (1e-6, None, None)
    if depth:
        for name, v in x.items():
            for t in np.unique(np.quantile(v, [0.1, 0.25, 0.5, 0.75, 0.9, 1])) if v.min() < v.max() else ():
                low = v < t
                if low.any():
                    gain = sum(gradient[s].sum() ** 2 / (hessian[s].sum() + 1.0) for s in (low, ~low)) - gradient.sum() ** 2 / (hessian.sum() + 1.0)
                    best = max(best, (gain, name, float(t)), key=lambda b: b[0])
    if best[1] is None:
        return leaf
    low = x[best[1]] < best[2]
    return best[1], best[2], *(_tree({k: v[s] for k, v in x.items()}, gradient[s], hessian[s], depth - 1, rate) for s in (low, ~low))


def _value(tree, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return np.full(n, tree) if isinstance(tree, float) else np.where(x[tree[0]] < tree[1], _value(tree[2], x, n), _value(tree[3], x, n))


def boosted(x: dict[str, np.ndarray], y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.95) -> Model | None:
    """Trees fitted on the even rows by logistic loss; the least threshold that is so precise on the odd ones."""
    fit, held = np.arange(len(y)) % 2 == 0, np.arange(len(y)) % 2 == 1
    if not (0 < y[fit].mean() < 1) or not y[held].any():
        return None
    bias = math.log(y[fit].mean() / (1 - y[fit].mean()))
    score, trees, part = np.full(fit.sum(), bias), [], {k: v[fit] for k, v in x.items()}
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(part, y[fit] - p, p * (1 - p), depth, rate))
        score += _value(trees[-1], part, fit.sum())
    scores = bias + sum(_value(t, {k: v[held] for k, v in x.items()}, held.sum()) for t in trees)
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
    ends = np.append(np.diff(scores[order]) < 0, True)  # equal scores are taken together
    good = np.flatnonzero((right >= precision) & ends)
    return Model(bias, trees, float(scores[order][good[-1]])) if len(good) else None


def _expression(tree, x: dict[str, Column]) -> Column:
    return F.lit(tree) if isinstance(tree, float) else F.when(x[tree[0]] < tree[1], _expression(tree[2], x)).otherwise(_expression(tree[3], x))


def sound(kind: Column, found: Column) -> Column:
    """The check of a proposal's kind, whatever signs part its digits."""
    plain = F.regexp_replace(found, "[^0-9]+", ".")
    out = F.lit(True)
    for k in KINDS:
        out = F.when(kind == k, passes(k, plain if k == "ip" else found)).otherwise(out)
    return out


def free(base: DataFrame) -> DataFrame:
    """Adds to what `base_spans` gives _proposed, the sound proposals that overlap no base span."""
    all_ = candidates(base.withColumn("_all", F.concat(*(F.col(f"_base_{k}") for k in KINDS))))
    return all_.withColumn("_proposed", F.filter("_proposed", lambda c: ~F.exists("_all", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])) & sound(c["kind"], c["found"])))


def _labelled_texts() -> list[tuple[str, str | None, int, int]]:
    """(text, kind, start, end) of all forms in their contexts; no kind where none of the text is personal data."""
    rows = []
    for kind, forms in FORMS.items():
        for form in forms:
            for context in CONTEXTS[kind]:
                start = context.index("{}")
                rows.append((context.format(form), kind, start, start + len(form)))
            for context in OTHERWISE[kind]:
                rows.append((context.format(form), None, 0, 0))
    return rows + [(context.format(x), None, 0, 0) for x in ALIKE for context in ANYWHERE]


def fit(docs: DataFrame) -> Model | None:
    """Fitted on the labelled table, on just the proposals that `found` would judge; none for a table without rows."""
    if docs.isEmpty():
        return None
    quoted = lambda x: "CAST(NULL AS STRING)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quoted(t)}, {quoted(k)}, {a}, {b})" for t, k, a, b in _labelled_texts())
    texts = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(text, _kind, _start, _end)").repartition(1)
    c = F.col("c")
    rows = free(base_spans(texts)).select("*", F.explode("_proposed").alias("c"))
    y = F.coalesce((c["kind"] == F.col("_kind")) & (c["start"] == F.col("_start")) & (c["end"] == F.col("_end")), F.lit(False))
    order = F.xxhash64("text", "c.start", "c.kind")
    rows = rows.select(*(v.alias(k) for k, v in _features(c["kind"], F.col("text"), c).items()), y.cast("int").alias("_y"), order.alias("_order")).orderBy("_order").collect()
    names = [n for n in rows[0].asDict() if n[0] != "_"]
    return boosted({n: np.array([r[n] for r in rows]) for n in names}, np.array([r["_y"] for r in rows], float))


def found(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (doc_id if not given), text, _base_<kind> and _added, the selected proposals with their kinds and scores."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != "text"]
    base = base_spans(docs.select(*keep, "text"))
    if model is None:
        return base.withColumn("_added", F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))
    judged = free(base)

    def scored(c: Column) -> Column:
        x = _features(c["kind"], F.col("text"), c)
        score = F.lit(model.bias)
        for tree in model.trees:
            score = score + _expression(tree, x)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), score.alias("score"))

    good = F.array_sort(F.filter(F.transform("_proposed", scored), lambda c: c["score"] >= model.threshold))
    spans = "array<struct<start:int,end:int,kind:string,score:double>>"

    def best(kept: Column, c: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (last["end"] <= c["start"]), F.array_append(kept, c)).when(c["score"] > last["score"], F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), c)).otherwise(kept)

    taken = F.when(F.size("_proposed") > 0, F.aggregate(good, F.array().cast(spans), best)).otherwise(F.array().cast(spans))
    added = F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["score"].alias("score")))
    return judged.select(*keep, "text", *(f"_base_{k}" for k in KINDS), added.alias("_added"))


def _tagged(kind: str) -> Column:
    return F.transform(f"_base_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _all_spans(added: bool) -> Column:
    nth = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int") - 1
    more = F.transform("_added", lambda s: F.struct(s["start"].alias("start"), nth(s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(F.concat(*map(_tagged, KINDS), *([more] if added else [])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted() -> Column:
    """The text with every span of `found` replaced by its kind in brackets; of overlapping spans the first one names the whole."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(so_far: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), so_far["at"] + 1, F.greatest(s["start"] - so_far["at"], F.lit(0)))
        fresh = F.concat(so_far["parts"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), F.when(s["start"] >= so_far["at"], fresh).otherwise(so_far["parts"]).alias("parts"))

    def finish(x: Column) -> Column:
        return F.concat(F.array_join(x["parts"], ""), F.substring(F.col("text"), x["at"] + 1, F.length("text")))

    spans = _all_spans(True)
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(F.col("text"))


def masked(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows with their columns; personal data in the text are replaced by their kind."""
    rows = found(packed(docs), model, ["_row"])
    return unpacked(rows.select("_row", redacted().alias("text")), docs)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return found(docs, fit(docs)).select(
        "doc_id", *(F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(_all_spans(False)), 256).alias("base_sha256"), _joined(_all_spans(True)).alias("spans")
    )
