"""Standard items from filing facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import union_all


def normalised(tag: Column) -> Column:
    """A tag without its prefix, lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(tag, "^[^:]*:", "")), "[^a-z0-9]", "")


def map_tags(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds ``item`` by ``mapping(tag, item, n)``; a later duplicate (greater n) wins."""
    table = mapping.groupBy(normalised(F.col("tag")).alias("k")).agg(F.max_by("item", "n").alias("item"))
    return facts.withColumn("k", normalised(F.col("tag"))).join(table, "k", "left").drop("k")


#: Items by words that a tag must hold, all of them; the first that fits counts.
KEYWORDS = (
    ("xopr", "operating expense"), ("nopi", "operating income"), ("lo", "liabilities other"), ("lco", "liabilities current other"), ("xido", "interest income"), ("txp", "income tax payable current"),
    ("txdi", "deferred tax expense"), ("dvp", "dividend paid"), ("ch", "cash increase decrease change"), ("csh12", "twelve month share"), ("epsx12", "twelve month earnings pershare"), ("recta", "accounts receivable trade"),
)


def fuzzy(tags: DataFrame, mapping: DataFrame, above: float = 0.7, keywords=KEYWORDS) -> DataFrame:
    """Items ``(tag, item, how)`` of distinct tags without an exact match; tags for which nothing fits have no row.

    ``similar``: the tag contains an entry of ``mapping(tag, item, n)`` or is contained in one, and more than ``above`` of the
    letters of both together are common to them; the lowest n wins.  ``keywords``: else, the first item all of whose words
    the tag contains.

    A text can only contain another if it contains its first letters, so both directions are joins by key: the first
    ``GRAM`` letters of the shorter one (all, if it has fewer) against the letter groups of the longer one.  No pair is lost.
    """
    a = tags.select("tag", normalised(F.col("tag")).alias("a")).where("a <> ''").distinct()
    b = mapping.select(normalised(F.col("tag")).alias("b"), "item", "n").where("b <> ''")
    pairs = _containing(a, "a", b, "b").unionByName(_containing(b, "b", a, "a")).distinct()
    letters = lambda c: F.array_distinct(F.split(F.col(c), ""))
    similar = F.size(F.array_intersect(letters("a"), letters("b"))) / F.size(F.array_union(letters("a"), letters("b")))
    first = pairs.where(similar > above).groupBy("tag").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    out = a.join(first, "tag", "left")
    holds = lambda words: reduce(lambda x, y: x & y, [F.contains("a", F.lit(w)) for w in words.split()])
    by_word = F.coalesce(*(F.when(holds(words), item) for item, words in keywords)) if keywords else F.lit(None).cast("string")
    how = F.when(F.col("item").isNotNull(), "similar").otherwise("keywords")
    return out.select("tag", F.coalesce("item", by_word).alias("item"), how.alias("how")).where("item is not null")


GRAM = 4


def _containing(longer: DataFrame, x: str, shorter: DataFrame, y: str) -> DataFrame:
    """Pairs of rows in which ``x`` contains ``y``."""
    group = lambda size: F.when(F.length(x) >= size, F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substr(x, i, F.lit(size)))).otherwise(F.array())
    keyed = longer.withColumn("_g", F.explode(F.array_distinct(F.concat(*(group(k) for k in range(1, GRAM + 1))))))
    return keyed.join(shorter.withColumn("_g", F.substring(y, 1, GRAM)), "_g").where(F.contains(x, y)).drop("_g")


def widen(rows: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """One column per item, the largest value of each."""
    return rows.groupBy(*keys).pivot("item", items).agg(F.max("value"))


class Rule(NamedTuple):
    """``target`` is worked out of ``inputs`` by ``value``; ``mode``: ``missing`` fills it where it is null, ``larger`` also where
    the outcome is greater, ``always`` replaces it wherever there is an outcome.  ``reported`` inputs are taken as they came in."""

    target: str
    inputs: tuple[str, ...]
    value: Callable[..., Column]
    mode: str = "missing"
    reported: bool = False


def _table(text: str) -> list[tuple[str, list[str]]]:
    return [(k.strip(), v.split()) for k, _, v in (part.partition(":") for part in text.split(";"))]


#: Items that repeat another, that are four times another, and that are estimated as a share of another.
REPEATS = "ni: ib ibcom; ib: ibadj; ceq: seq cstke teq; tstkn: tstk; ao: alto; mib: mii mibt ltmib; ci: citotal cibegni; cicurr: cidergl; xopt: xoptd xoptp; xoptd: xoptdp; epspi: epsfx epsfi; opeps: oepsx; cshpr: prsho pnrsho; csho: cshop; lo: loxdr; stkco: esopt; esopt: esopct stkcpa"
FOURFOLD = "epspi: epsf12 epsfi12; opeps: oeps12 oepf12; epspx: epsx12 epspi12; ibadj: ibadj12; xi: glcea12; dp: glced12; cshpr: csh12; cshfd: cshfd12"
SHARES = (("cipen", "ci", 0.3), ("drc", "dp", 0.8), ("drlt", "dp", 0.2), ("dd1", "dp", 0.5), ("hedgegl", "xi", 0.1), ("xacc", "lo", 0.5), ("esopnr", "esopt", 0.8), ("esopr", "esopt", 0.2))
#: Items that are the sum of whatever parts there are.
SUMS = "xsga: sellmkt genadm xrd; xopt: xsga xrd; pstk: pstkr pstkn; ao: aco anc"


def _some(*parts: Column) -> Column:
    """Sum of the parts that are there."""
    total = reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def _per(x: Column, shares: Column) -> Column:
    return F.when(shares > 0, x / shares)


RULES = (
    Rule("che", ("cash", "sti"), lambda c, s: F.when((F.coalesce(c, F.lit(0.0)) > 0) | (F.coalesce(s, F.lit(0.0)) > 0), _some(c, s)), "larger"),
    Rule("oibdp", ("oiadp", "dp"), lambda x, d: x + d, "always"),
    Rule("oibdp", ("sale", "cogs", "xsga"), lambda x, c, g: x - c - g),
    Rule("gp", ("revt", "cogs"), lambda x, c: x - c),
    Rule("gp", ("sale", "cogs"), lambda x, c: x - c),
    Rule("wcap", ("act", "lct"), lambda a, b: a - b),
    Rule("icapt", ("ceq", "dltt"), lambda e, d: e + d),
    Rule("icapt", ("at", "lct", "dltt"), lambda a, b, d: a - b + d),
    Rule("dcom", ("dlc", "dltt"), lambda a, b: a + b),
    Rule("at", ("lt", "ceq"), lambda a, b: a + b, reported=True),
    Rule("lt", ("at", "ceq"), lambda a, b: a - b, reported=True),
    Rule("spi", ("sale", "cshpr"), _per),
    Rule("opeps", ("oiadp", "cshpr"), _per),
    *(Rule(target, tuple(parts), _some) for target, parts in _table(SUMS)),
    *(Rule(target, (source,), lambda x: x) for source, targets in _table(REPEATS) for target in targets),
    *(Rule(target, (source,), lambda x: x * 4) for source, targets in _table(FOURFOLD) for target in targets),
    *(Rule(target, (source,), lambda x, share=share: x * share) for target, source, share in SHARES),
)


def levels(rules, columns: list[str]) -> list[list[Rule]]:
    """Rules by level: a rule stands above all rules for its inputs, and rules for one target stand together in their order.

    Sums take part with any of their parts, other rules with all of their inputs.  A circle is refused.
    """
    known, usable, left = set(columns), [], list(rules)
    while found := [r for r in left if (any if r.value is _some or r.target == "che" else all)(i in known for i in r.inputs)]:
        usable += found
        known |= {r.target for r in found}
        left = [r for r in left if r not in found]
    usable.sort(key=list(rules).index)
    needs = {t: {i for r in usable if r.target == t and not r.reported for i in r.inputs} for t in {r.target for r in usable}}
    depth: dict[str, int] = {}

    def rank(target: str, above: tuple[str, ...] = ()) -> int:
        if target in above:
            raise ValueError("rules in a circle: " + " -> ".join((*above, target)))
        if target not in depth:
            depth[target] = 1 + max((rank(i, (*above, target)) for i in needs[target] if i in needs), default=-1)
        return depth[target]

    for target in sorted(needs):
        rank(target)
    return [[r for r in usable if depth[r.target] == level] for level in range(max(depth.values(), default=-1) + 1)]


def derive(wide: DataFrame, rules=RULES) -> DataFrame:
    """Works out items from others, however many steps apart: one projection for each level of the rules."""
    first = wide.columns
    if any(r.reported for r in rules):
        wide = wide.withColumns({f"_reported_{i}": F.col(i) for i in {i for r in rules if r.reported for i in r.inputs} & set(first)})
    for level in levels(rules, first):
        new: dict[str, Column] = {}
        for r in level:
            at = lambda i, r=r: F.col(f"_reported_{i}" if r.reported and f"_reported_{i}" in wide.columns else i) if i in wide.columns else F.lit(None).cast("double")
            value = r.value(*(at(i) for i in r.inputs))
            old = new.get(r.target, F.col(r.target) if r.target in wide.columns else F.lit(None).cast("double"))
            new[r.target] = F.coalesce(value, old) if r.mode == "always" else F.greatest(old, value) if r.mode == "larger" else F.coalesce(old, value)
        wide = wide.withColumns(new)
    return wide.drop(*(c for c in wide.columns if c.startswith("_reported_")))


def cost_less_depreciation(wide: DataFrame) -> DataFrame:
    """Cost of sales without the depreciation that filings count in; where that is not reported the cost stays."""
    return wide.withColumn("cogs", F.col("cogs") - F.coalesce("dp", F.lit(0.0)))


def debt_with_leases(wide: DataFrame, most: float = 1e9, replace: float = 1.1) -> DataFrame:
    """Long-term debt with non-current leases, current debt with current ones; dollars become millions above ``most``."""
    millions = lambda c: F.when(F.abs(F.col(c)) > most, F.col(c) / 1e6).otherwise(F.col(c))
    for out, lease in (("dltt", "lease_noncurrent"), ("dlc", "lease_current")):
        total = millions(out) + F.coalesce(millions(lease), F.lit(0.0))
        wide = wide.withColumn(f"{out}_with_leases", F.when(total > replace * millions(out), total).otherwise(millions(out)))
    return wide


def preferred_source(facts: DataFrame, order: list[str]) -> DataFrame:
    """Of several tags for one item, the value of the first in ``order`` that a filing has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("tag"))
    rows = facts.where(F.col("tag").isin(order) & F.col("value").isNotNull())
    return rows.groupBy("id").agg(F.min_by(F.struct("tag", "value"), rank).alias("v")).select("id", "v.tag", "v.value")


#: Items of revenue and income, which a large loss as first reported does not enter.
INCOME_ITEMS = ("revt", "sale", "ni", "ib", "ibcom", "oiadp", "oibdp", "pi", "nopi")


def revise(facts: DataFrame, least: float = -1e6, income=INCOME_ITEMS) -> DataFrame:
    """One row of ``(company, fy, fq, item, effective, through, value)`` per key: the newest, then the larger amount.

    Only items of ``income`` are held against ``least``.
    """
    w = Window.partitionBy("company", "fy", "fq", "item").orderBy(F.desc_nulls_last("effective"), F.desc_nulls_last("through"), F.desc(F.abs("value")), F.desc("value"))
    rows = facts.where((F.col("value") >= least) | ~F.col("item").isin(*income)).withColumn("n", F.row_number().over(w))
    return rows.where("n = 1").drop("n")


def company_table(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """First non-blank value of each column in order of filing."""
    rank = F.struct(order)
    first = [F.min_by(F.nullif(F.trim(F.col(c)), F.lit("")), F.when(F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull(), rank)).alias(c) for c in columns]
    return rows.groupBy(key).agg(*first)


def most_common(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Most frequent value of each group; the smaller one among equals."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), value)
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def fill_gaps(ours: DataFrame, reference: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Missing values come from the reference, and those that differ by more than ``tolerance`` are replaced; a null or
    zero reference says nothing."""
    ref = reference.where("value is not null and value <> 0").select(*keys, F.col("value").alias("ref"))
    both = ours.join(ref, keys, "full")
    take = F.col("ref").isNotNull() & (F.col("value").isNull() | (F.abs(F.col("value") - F.col("ref")) > tolerance))
    return both.select(*keys, F.when(take, F.col("ref")).otherwise(F.col("value")).alias("value"), F.when(take & F.col("value").isNull(), "inserted").when(take, "replaced").otherwise("kept").alias("action"))


def industry_codes(companies: DataFrame, known: DataFrame, fixed: DataFrame) -> DataFrame:
    """Code of each ``(company, sic)``: its own, else the most common of its SIC, else the fixed table's."""
    mode = most_common(known.join(companies, "company").select("sic", "code"), "sic", "code").select("sic", F.col("code").alias("m"))
    out = companies.join(known.select("company", "code"), "company", "left").join(mode, "sic", "left").join(fixed.select("sic", F.col("code").alias("f")), "sic", "left")
    return out.select("company", "sic", F.coalesce("code", "m", "f").alias("code"))


def warnings(wide: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows (…keys, item, value) of items whose amount is above its limit."""
    keys = [c for c in wide.columns if c not in limits]
    parts = [wide.where(F.abs(c) > limit).select(*keys, F.lit(c).alias("item"), F.col(c).alias("value")) for c, limit in limits.items()]
    return union_all(parts)


def breakouts(wide: DataFrame, triples: list[tuple[str, str, str]]) -> DataFrame:
    """Totals broken out into two parts: of (total, part, rest) the one that is missing follows from the other two."""
    for total, part, rest in triples:
        t, p, r = F.col(total), F.col(part), F.col(rest)
        wide = wide.withColumns({total: F.coalesce(t, p + r), part: F.coalesce(p, t - r), rest: F.coalesce(r, t - p)})
    return wide
