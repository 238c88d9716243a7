"""Secret scans by a trigram inverted index (operator 5), in DataFrame operations alone.

From each rule's pattern a Boolean query over trigrams is derived that every match's text fulfils: an AND of
ORs of ANDs. Documents are indexed (in lower case) under the trigrams that any rule's query names; the
postings of a query are intersected, and only the documents left are scanned for that rule. A rule without a
mandatory trigram (hex) scans every document in full. Whole texts are scanned.

Matches are leftmost and don't overlap within a kind; a match that fails its rule's length is dropped and scanning goes
on behind it. Spans are in code points, end exclusive, over the whole match. Null text is empty. Repeated rows each get a row; an
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as parts
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """pattern: for Java, Python and RE2 alike. The match's group must have at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs of [0-9a-f] are maximal, so this finds those of 24 and more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, False),
)

#: A query: all of its factors hold; a factor holds if all trigrams of one of its members are there.
Query = list[set[frozenset[str]]]


def trigram_query(pattern: str, most: int = 64) -> Query:
    """What every text with a match must hold, in lower case; empty if nothing is mandatory."""
    factors: list[set[str]] = []

    def exact(tree: parser.SubPattern) -> set[str] | None:
        """All strings that the tree matches, in lower case, if they are few."""
        out = {""}
        for op, arg in tree:
            if op is parts.LITERAL:
                own = {chr(arg).lower()}
            elif op is parts.IN and all(o in (parts.LITERAL, parts.RANGE) for o, _ in arg):
                own = {chr(c).lower() for o, a in arg for c in ([a] if o is parts.LITERAL else range(a[0], a[1] + 1))}
            elif op is parts.SUBPATTERN:
                own = exact(arg[-1])
            elif op is parts.BRANCH:
                each = [exact(x) for x in arg[1]]
                own = None if None in each else set().union(*each)
            elif op is parts.MAX_REPEAT and arg[1] <= 8 and (once := exact(arg[2])) is not None:
                own = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(once, repeat=n) if len(once) ** n <= most}
                own = own if sum(len(once) ** n for n in range(arg[0], arg[1] + 1)) <= most else None
            else:
                own = None
            if own is None or len(out) * len(own) > most:
                return None
            out = {a + b for a in out for b in own}
        return out

    def walk(tree: parser.SubPattern) -> None:
        run = {""}
        for node in tree:
            alone = parser.SubPattern(tree.state, [node])
            own = exact(alone)
            if own is not None and len(own) * len(run) <= most:
                run = {a + b for a in run for b in own}
                continue
            factors.append(run)
            run = {""} if own is None else own
            if own is None and node[0] is parts.SUBPATTERN:
                walk(node[1][-1])
        factors.append(run)

    walk(parser.parse(pattern))
    return [{frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run} for run in factors if all(len(x) >= 3 for x in run)]


def index_key() -> F.Column:
    """What documents are indexed under. Two documents that happen to share it are both candidates, which harms nothing."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram and key of every document that holds it, for the trigrams asked for."""
    low = docs.select(index_key().alias("key"), F.lower("text").alias("low"))
    named = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("key", F.explode(named).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], queries: dict[str, Query]) -> DataFrame:
    """key and kinds: the rules whose queries the key's trigrams fulfil."""
    def holds(query: Query) -> F.Column:
        one = lambda grams: reduce(lambda a, b: a & b, (F.array_contains("grams", g) for g in sorted(grams)))
        return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, map(one, sorted(factor, key=sorted))) for factor in query))

    gathered = index.groupBy("key").agg(F.collect_set("trigram").alias("grams"))
    kinds = F.array_compact(F.array(*(F.when(holds(queries[r.kind]), F.lit(r.kind)) for r in rules if queries[r.kind])))
    return gathered.select("key", kinds.alias("kinds")).where("size(kinds) > 0")


def spans(rule: Rule, order: int, wanted: F.Column) -> F.Column:
    """start, order, end of the rule's matches in text: gaps come from splitting by the pattern, lengths from the matches."""
    pattern = F.lit(rule.pattern)
    text = F.col("text")
    gaps, whole = F.split(text, rule.pattern), F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), checked.alias("checked")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["whole"]), F.lit(-1)).alias("n"), F.length(x["checked"]).alias("checked")))
    none = F.lit([]).cast("array<struct<start:int,order:int,end:int>>")
    found = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.greatest(x["n"], F.lit(0))).alias("at"),
            F.when((x["n"] > 0) & (x["checked"] >= rule.least), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("order"), (acc["at"] + x["gap"] + x["n"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(wanted & text.rlike(rule.pattern), found).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of start, order, end; order is the rule's place in rules) and counts of each kind."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    trigrams = sorted({g for q in queries.values() for factor in q for grams in factor for g in grams})
    index = stored(postings(docs, trigrams), "trigrams")
    found = candidates(index, rules, queries)
    joined = docs.withColumn("key", index_key()).join(found, "key", "left")
    columns = {f"at_{r.kind}": spans(r, i, F.array_contains("kinds", r.kind) if queries[r.kind] else F.lit(True)) for i, r in enumerate(rules)}
    return joined.withColumns(columns).drop("key", "kinds")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The digest of scan(): doc_id, n_<kind> of base kinds, base_sha256 and spans."""
    found = scan(docs, rules)
    names = F.array(*(F.lit(r.kind) for r in rules))

    def told(which: list[Rule]) -> F.Column:
        merged = F.array_sort(F.concat(*(F.col(f"at_{r.kind}") for r in which)))
        return F.array_join(F.transform(merged, lambda x: F.concat_ws(":", F.get(names, x["order"]), x["start"], x["end"])), ",")

    base = [r for r in rules if r.base]
    counts = [F.size(f"at_{r.kind}").cast("bigint").alias(f"n_{r.kind}") for r in base]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(list(rules)).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same over a view documents, without the index, for DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def kind(i: int, r: Rule) -> str:
        at = f"list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda w: length(w))), 0)"
        return f"""select id, {i} as ord, {q(r.kind)} as kind, {str(r.base).lower()} as base, cast({at} as bigint) as s, cast({at} + length(whole[k]) as bigint) as e
        from (select *, unnest(range(1, len(whole) + 1)) as k from (select id, string_split_regex(text, {q(r.pattern)}) as gaps,
          regexp_extract_all(text, {q(r.pattern)}, 0) as whole, regexp_extract_all(text, {q(r.pattern)}, {r.group}) as checked from d where regexp_matches(text, {q(r.pattern)})))
        where length(checked[k]) >= {r.least}"""

    each = "\n  union all ".join(kind(i, r) for i, r in enumerate(rules))
    counts = ", ".join(f"count(*) filter (where kind = {q(r.kind)}) as n_{r.kind}" for r in rules if r.base)
    told = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, ord){}, '')"
    return f"""with d as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
    m as ({each})
    select doc_id, {counts}, sha256({told.format(" filter (where base)")}) as base_sha256, {told.format(" filter (where kind is not null)")} as spans
    from d left join m using (id) group by d.id, doc_id"""
