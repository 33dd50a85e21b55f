"""Personal data by weak supervision, with DataFrame functions only.

Four base kinds are found by fixed rules (email, ip, card, phone) and always stay.  Further candidates (credentials,
identity and account numbers, persons) come from broad patterns; on each of them labelers vote for, against or not at all:
a strict shape, a gazetteer, key words before it, an assignment or quotes around it, and the look of ordinary numbers.
Expectation-maximisation over the vote patterns estimates how reliable each labeler is and how likely each candidate is
personal; a log-linear span classifier is trained on these probabilities over features of the span, and decides.

Patterns of votes and features come from small fixed sets, so the tables that EM and the classifier are fitted on have a
fixed maximum of rows whatever the input; they count all candidates of all documents.

Offsets are code points, ends exclusive.  Null counts as empty; repeated rows and ids give one row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.store import keep

# Each pattern takes what the plain rule takes; the look-behinds and possessive repeats only keep the search linear.
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GIVEN_NAMES = (
    "Alice|Anna|Ben|Carlos|Charles|Chloe|Claire|Daniel|David|Elena|Emily|Emma|Eva|Fatima|George|Hannah|Hans|Helen|Ivan|Jack|James|"
    "Jane|Jean|John|Jose|Julia|Karen|Laura|Linda|Louis|Lucas|Luis|Maria|Marie|Mark|Martin|Mary|Michael|Mohammed|Nina|Oliver|Omar|"
    "Paul|Peter|Pierre|Robert|Sarah|Sofia|Susan|Thomas|Victor|Wei|William|Yuki")
EXTRA = {
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,64}[0-9])[A-Za-z0-9_+/=-]{20,}+",
    "number": r"(?<![A-Za-z0-9.,/+-])[A-Z]{0,2}[0-9]++(?:[\x20-][0-9]{2,}+)*+(?![A-Za-z0-9]|[.,/-][0-9])",
    "person": rf"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof)\. |(?:{GIVEN_NAMES}) )[A-Z][a-z]++(?: [A-Z][a-z]++)?+",
}
KINDS = [*BASE, *EXTRA]
#: Texts without this are not searched for the kind at all.
NEEDS = {"email": "@", "phone": "+"}
KEY_WORDS = r"(?i)(token|secret|passw|api.?key|access.?key|credential|bearer|ssn|social security|passport|account|iban|tax|licen[cs]e no|customer|patient|name|contact|call|tel|signed|dear)\W*[\"'=:#(\s]*$"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|sk_|pk_|eyJ|AIza|glpat-)"
SHAPES = {
    "secret": r"^(?:[0-9a-f]{32}|[0-9A-F]{32}|[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9A-F]{64}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_+/=-]{24,})$",
    "number": r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[ 0-9-]{11,}|[A-Z]{1,2}[0-9]{6,9})$",
    "person": r"^(?:Mr|Mrs|Ms|Dr|Prof)\. ",
}
VOTES = ("v_shape", "v_gazetteer", "v_context", "v_assigned", "v_ordinary")
FEATURES = ("f_kind", "f_length", "f_digits", "f_context", "f_case")
ROUNDS = 25


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of up to 19 digits is right."""
    at = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    n = F.length(digits)

    def add(total, i):
        twice = at(i) * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(at(i))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_holds(kind: Column, m: Column) -> Column:
    """The check behind the pattern of a base kind; a match that fails it is dropped."""
    size = F.length(_digits(m))
    parts = F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    # The inner test keeps the digit sum from running over anything but 16 to 19 digits.
    card = F.when(size.between(16, 19), luhn(F.when(size.between(16, 19), _digits(m)).otherwise(F.lit("0")))).otherwise(F.lit(False))
    return F.when(kind == "ip", parts).when(kind == "card", card).when(kind == "phone", size.between(8, 15)).otherwise(F.lit(True))


def matches(docs: DataFrame) -> DataFrame:
    """One row per match with its place and surroundings, and one row without a match per document without any."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = []
    for k, (kind, pattern) in enumerate({**BASE, **EXTRA}.items()):
        test = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("text").rlike(pattern)
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = F.split("text", pattern, -1)
        item = F.transform(F.arrays_zip(hits.alias("m"), gaps.alias("g")), lambda x, i: F.struct(
            F.lit(k).alias("kind"), i.alias("i"), x["m"].alias("m"), F.length(x["g"]).alias("gap"), F.right(x["g"], F.lit(32)).alias("before"),
            F.left(x["g"], F.lit(4)).alias("after")))
        found.append(F.when(test, item))
    none = F.array().cast("array<struct<kind:int,i:int,m:string,gap:int,before:string,after:string>>")
    every = F.concat(*[F.coalesce(f, none) for f in found])
    # The last gap of a kind follows its last match: its item has no match, and lends its head to the item before.
    return rows.select("row", "doc_id", F.explode_outer(every).alias("x")).select("row", "doc_id", "x.*")


def placed(found: DataFrame) -> DataFrame:
    """Start and end of each match: running sums over the matches and gaps of one document and kind."""
    by = "PARTITION BY row, kind ORDER BY i"
    return found.withColumns({
        "end": F.expr(f"sum(gap + coalesce(length(m), 0)) OVER ({by})"),
        "after": F.expr(f"lead(after) OVER ({by})"),
    }).filter("m IS NOT NULL OR kind IS NULL").select(
        "row", "doc_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind"), F.col("kind").alias("rank"),
        "m", (F.col("end") - F.length("m")).alias("start"), "end", "before", F.coalesce("after", F.lit("")).alias("after"))


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)


def with_votes(spans: DataFrame) -> DataFrame:
    """Votes of the labelers and the features of a span."""
    m, kind = F.col("m"), F.col("kind")
    strict = F.lit(False)
    for k, pattern in SHAPES.items():
        strict = strict | ((kind == k) & m.rlike(pattern))
    context = F.col("before").rlike(KEY_WORDS)
    share = F.length(_digits(m)) / F.length(m)
    short = (kind == "number") & (F.length(_digits(m)) < 7)
    return spans.withColumns({
        "v_shape": _vote(strict, short),
        "v_gazetteer": _vote(m.rlike(PREFIXES) | m.rlike(rf"^(?:Mr\. |Mrs\. |Ms\. |Dr\. |Prof\. )?(?:{GIVEN_NAMES}) ")),
        "v_context": _vote(context, (kind == "number") & ~context),
        "v_assigned": _vote(F.col("before").rlike(r"[=:]\s?[\"']?$") | (F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']"))),
        "v_ordinary": _vote(F.lit(False), m.rlike(r"^(?:1[0-9]{3}|20[0-9]{2}|[0-9]{1,5})$") | F.col("before").rlike(r"(?i)(version|page|chapter|no\.?|fig\.?|§)\s?$")
                            | m.rlike(r"(.)\1{7,}")),
        "f_kind": kind,
        "f_length": F.least(F.floor(F.log2(F.length(m))), F.lit(6)).cast("string"),
        "f_digits": F.round(share * 4).cast("int").cast("string"),
        "f_context": context.cast("string"),
        "f_case": F.concat(m.rlike("[a-z]").cast("string"), m.rlike("[A-Z]").cast("string")),
    })


def reliabilities(patterns: list[tuple[tuple[int, ...], float]]) -> tuple[float, list[list[list[float]]]]:
    """EM for two classes: share of personal spans, and P(vote | class) of each labeler, from counted vote patterns."""
    share = 0.3
    rates = [[[0.2, 0.6, 0.2], [0.1, 0.3, 0.6]] for _ in VOTES]  # [class][against, none, for]
    for _ in range(ROUNDS):
        mass = [1.0, 1.0]
        seen = [[[0.2, 0.6, 0.2], [0.1, 0.3, 0.6]] for _ in VOTES]
        for votes, n in patterns:
            p = posterior(votes, share, rates)
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                mass[c] += w
                for j, v in enumerate(votes):
                    seen[j][c][v + 1] += w
        share = mass[1] / (mass[0] + mass[1])
        rates = [[[x / sum(row) for x in row] for row in labeler] for labeler in seen]
    return share, rates


def posterior(votes: tuple[int, ...], share: float, rates: list[list[list[float]]]) -> float:
    odds = math.log(share / (1 - share))
    odds += sum(math.log(r[1][v + 1] / r[0][v + 1]) for v, r in zip(votes, rates))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def classifier(table: list[tuple[tuple[str, ...], float, float]]) -> tuple[float, dict[tuple[int, str], float]]:
    """Log-linear weights of the features from (features, count, expected personal count)."""
    yes, no = 1.0 + sum(p for _, _, p in table), 1.0 + sum(n - p for _, n, p in table)
    counts: dict[tuple[int, str], list[float]] = {}
    for features, n, p in table:
        for j, f in enumerate(features):
            c = counts.setdefault((j, f), [0.5, 0.5])
            c[0] += n - p
            c[1] += p
    return math.log(yes / no), {k: math.log((c[1] / yes) / (c[0] / no)) for k, c in counts.items()}


def scored(spans: DataFrame) -> DataFrame:
    """Candidates of the extra kinds with ``p_votes`` (after EM) and ``p_span`` (of the final classifier)."""
    seen = with_votes(spans)
    counted = seen.groupBy(*VOTES, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns: dict[tuple[int, ...], float] = {}
    for r in counted:
        votes = tuple(r[v] for v in VOTES)
        patterns[votes] = patterns.get(votes, 0.0) + r["n"]
    share, rates = reliabilities(sorted(patterns.items()))
    table: dict[tuple[str, ...], list[float]] = {}
    for r in sorted(counted, key=lambda r: (tuple(r[v] for v in VOTES), tuple(r[f] for f in FEATURES))):
        t = table.setdefault(tuple(r[f] for f in FEATURES), [0.0, 0.0])
        t[0] += r["n"]
        t[1] += r["n"] * posterior(tuple(r[v] for v in VOTES), share, rates)
    bias, weights = classifier([(f, n, p) for f, (n, p) in sorted(table.items())])
    total = F.lit(bias)
    for j, f in enumerate(FEATURES):
        known = [x for (k, v), w in weights.items() if k == j for x in (F.lit(v), F.lit(w))]
        total = total + (F.coalesce(F.element_at(F.create_map(*known), F.col(f)), F.lit(0.0)) if known else F.lit(0.0))
    odds = F.lit(math.log(share / (1 - share)))
    for v, r in zip(VOTES, rates):
        log = [F.lit(math.log(r[1][i] / r[0][i])) for i in range(3)]
        odds = odds + F.element_at(F.array(*log), F.col(v) + 2)
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return seen.withColumn("p_votes", sigmoid(odds)).withColumn("p_span", sigmoid(total))


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Spans and counts of every row; candidates count from the probability ``least`` up."""
    found = keep(placed(matches(docs)))
    base = found.filter(F.col("rank").isNull() | (F.col("rank") < len(BASE)))
    base = base.filter(F.col("rank").isNull() | base_holds(F.col("kind"), F.col("m"))).withColumn("personal", F.lit(True))
    more = scored(found.filter(F.col("rank") >= len(BASE)))
    more = more.withColumn("personal", (F.col("p_span") + F.col("p_votes")) / 2 >= least)
    columns = ["row", "doc_id", "rank", "kind", "start", "end"]
    spans = base.select(*columns).unionByName(more.filter("personal").select(*columns)) \
        .unionByName(found.select("row", "doc_id").distinct().selectExpr(
            "row", "doc_id", "int(null) rank", "string(null) kind", "bigint(null) start", "bigint(null) end"))
    item = F.when(F.col("rank").isNotNull(), F.struct("rank", "start", "end", "kind"))
    grouped = spans.groupBy("row").agg(F.first("doc_id", True).alias("doc_id"), F.array_sort(F.collect_list(item)).alias("all"))
    fixed = F.filter("all", lambda x: x["rank"] < len(BASE))
    # A candidate that touches a base span adds nothing; base spans are looked up in order of their start.
    added = F.filter("all", lambda x: (x["rank"] >= len(BASE)) & ~F.exists(
        F.col("fixed"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    text = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda k: F.size(F.filter("fixed", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return grouped.withColumn("fixed", fixed).withColumn("spans", F.concat("fixed", added)).select(
        "doc_id", *[count(k) for k in BASE], F.sha2(text(F.col("fixed")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
