"""Quality rules with verdicts on hosts (operator 13).

Rules count what is wrong with a text. Their failures are summed up by host (the column `source`); a host's rate of
failing is shrunk towards that of all hosts by a beta prior, whose two parameters are fitted to the rates of all hosts (moments, less the binomial noise of small
hosts). A host whose shrunk rate is over `most` for any rule loses all its documents; a document that fails the base rule goes by itself.

Rules, for n_words words: `base` (under 20 words, or over 30 % of them in repeated 8-word windows), `symbols` (over one character of [#*$%&|<>] for ten
words), `lines` (over 30 % of the lines with a word repeat an earlier one), `words` (mean length of a word outside 2 to 20 characters). A text without words fails `base`
alone.

Null and empty texts have no words and fail. Rows without a source belong to no host: only the base rule decides, and they count
for no host's rate. Repeated rows each count and each get a row; an empty table gives none. Columns other than
doc_id, text and source aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import Hasher, slices, text_bytes
from millrace.llm.common import stored, tidied
from millrace.llm.features import per_row
from millrace.llm.runs import BLOCK_BYTES, blank_bytes, repeated, stretches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("base", "symbols", "lines", "words")


def counts(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, source and COUNTS of every text. n_lines: lines with a word; n_dup_lines: those equal to an earlier one; n_repeat_words: words in windows that the text has twice or more."""
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    blank = blank_bytes()
    in_line = np.arange(256) != 10

    def act(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> pa.RecordBatch:
        n = len(batch)
        _, _, hashes, rows = hasher.words(raw, offsets, ~blank)
        twice = np.flatnonzero(repeated(stretches(hashes, rows, window)))
        change = np.zeros(len(rows) + 1, np.int64)
        change[twice] += 1
        change[twice + window] -= 1
        again = np.cumsum(change)[:-1] > 0
        starts, ends, of_lines, line_rows = hasher.words(raw, offsets, in_line)
        inner = np.concatenate([[0], np.cumsum(~blank[raw])])
        some = inner[ends] > inner[starts]
        of_lines, line_rows = of_lines[some], line_rows[some]
        _, first = np.unique(stretches(of_lines, line_rows, 1), return_index=True)
        columns = {
            "n_words": np.bincount(rows, minlength=n),
            "word_chars": per_row(~blank[raw] & ((raw & 0xC0) != 0x80), offsets),
            "n_symbols": per_row(symbols[raw], offsets),
            "n_lines": np.bincount(line_rows, minlength=n),
            "n_dup_lines": np.bincount(line_rows, minlength=n) - np.bincount(line_rows[first], minlength=n),
            "n_repeat_words": np.bincount(rows[again], minlength=n),
        }
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], *(pa.array(columns[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", "source", *COUNTS])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            raw, offsets = text_bytes(batch["text"])
            for first, last in slices(offsets, BLOCK_BYTES):
                yield act(batch.slice(first, last - first), raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], hasher)

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "source"))
    return docs.select("doc_id", "source", "text").mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def failures() -> dict[str, Column]:
    """Whether a row of counts() fails each rule; in whole numbers, so that all engines agree."""
    n = F.col("n_words")
    return {
        "base": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        "symbols": (n > 0) & (10 * F.col("n_symbols") > n),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "words": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
    }


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean m and weight w of the beta prior (w m, w (1 - m)) of each rule, from hosts with n and the failures of each rule.

    The variance of rates is that between hosts plus m (1 - m) / n of each; where nothing is left for the former, or there is but one host, hosts count as alike and w is a million. w is 2 (the weight of a
    uniform prior) at least, so that one failure doesn't condemn a host of one document.
    """
    rate = lambda r: F.col(r) / F.col("n")
    of_rule = [F.struct(F.avg(rate(r)).alias("m"), F.var_pop(rate(r)).alias("v")).alias(r) for r in RULES]
    got = hosts.agg(F.avg(1 / F.col("n")).alias("noise"), *of_rule).first()
    out = {}
    for r in RULES:
        m, v = got[r]["m"] or 0.0, got[r]["v"] or 0.0
        between = v - m * (1 - m) * (got["noise"] or 0.0)
        out[r] = (m, min(1e6, max(2.0, m * (1 - m) / between - 1)) if between > 0 else 1e6)
    return out


def verdicts(docs: DataFrame, most: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """counts() with what each rule says (fails_<rule>), and the hosts: source, n, failures of each rule, their shrunk rates (<rule>_rate) and `good`."""
    told = stored(counts(docs).select("*", *(f.alias(f"fails_{r}") for r, f in failures().items())), "rules")
    hosts = told.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), *(F.count_if(f"fails_{r}").alias(r) for r in RULES))
    hosts = stored(hosts, "rules-hosts")
    prior = priors(hosts)
    shrunk = {r: (F.col(r) + w * m) / (F.col("n") + w) for r, (m, w) in prior.items()}
    hosts = hosts.select("*", *(c.alias(f"{r}_rate") for r, c in shrunk.items()))
    return told, hosts.withColumn("good", F.greatest(*(f"{r}_rate" for r in RULES)) <= most)


def keep(docs: DataFrame, most: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept and host_rate (the shrunk rate of the base rule of the row's host, null without one)."""
    told, hosts = verdicts(docs, most)
    known = hosts.select(F.col("source").alias("host"), "good", F.col("base_rate").alias("host_rate"))
    joined = told.join(known, told["source"] == known["host"], "left")
    kept = ~F.col("fails_base") & F.coalesce("good", F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("fails_base").alias("base_failed"), kept.alias("kept"), "host_rate")


def report(docs: DataFrame) -> DataFrame:
    """keep() without rates."""
    return keep(docs).drop("host_rate")


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (
  select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, string_split(text, chr(10)) as ls,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols
  from d),
u as (select r, unnest(ls) as line from w),
l as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from u where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
s as (select r, ws, unnest(range(1, len(ws) - 6)) as i from w),
g as (select r, i, count(*) over (partition by r, array_to_string(ws[i:i + 7], ' ')) as n from s),
a as (select distinct r, unnest(range(i, i + 8)) as i from g where n > 1),
p as (select r, count(*) as n_repeat_words from a group by r),
c as (
  select doc_id, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, n_symbols, coalesce(n_lines, 0) as n_lines,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d join w using (r) left join l using (r) left join p using (r)),
f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, n_words > 0 and 10 * n_symbols > n_words as f2,
         10 * n_dup_lines > 3 * n_lines as f3, n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words) as f4
  from c),
h as (
  select source as host, rule, count(*) as n, count(*) filter (where failed) as k
  from (select source, unnest([1, 2, 3, 4]) as rule, unnest([base_failed, f2, f3, f4]) as failed from f where source is not null) group by all),
m as (select rule, avg(k / n) as m, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n) as v from h group by rule),
q as (select rule, m, case when v > 0 then least(1e6, greatest(2.0, m * (1 - m) / v - 1)) else 1e6 end as w from m),
v as (select host, max((k + w * m) / (n + w)) <= 0.5 as good from h join q using (rule) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(good, true) as kept
from f left join v on f.source = v.host
"""
