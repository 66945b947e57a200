"""Secret scans over a trigram inverted index.

From each rule's expression a Boolean trigram query is derived. Texts are indexed in blocks of
bounded size beside the data, so that postings never move; each rule's postings are intersected and
only the candidates are verified with its expression. Rules that lack mandatory trigrams (such as
bare hex) scan every text.

Defined results: null and empty texts have no spans; repeated rows each keep their row; an empty
table gives none; further columns of the input don't matter. Spans are in code points, end
exclusive, and may overlap between kinds, never within one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .trigrams import Index, dictionary, query_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if group ``group`` has at least ``least`` characters; matches
    are leftmost and don't overlap, and a failing one still takes up its text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = re.ASCII

    @property
    def query(self):
        return query_of(self.pattern, self.flags)


#: Fixed values of the contract, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
_B64 = "[A-Za-z0-9_-]"
#: Further kinds, after what the issuers publish of their formats: a prefix, and a run of the issuer's
#: alphabet that is as long as the shortest key issued. Runs are open-ended.
MORE = (
    Rule("github", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59})[A-Za-z0-9]*"),
    Rule("gitlab", rf"(?<![A-Za-z0-9])glpat-{_B64}{{20}}{_B64}*"),
    Rule("slack", r"(?<![A-Za-z0-9])xox[a-z]-[0-9]{8,}-[A-Za-z0-9-]{12,}"),
    Rule("stripe", r"(?<![A-Za-z0-9])(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{24,}"),
    Rule("google", rf"(?<![A-Za-z0-9])AIza{_B64}{{35}}"),
    Rule("sendgrid", rf"(?<![A-Za-z0-9])SG\.{_B64}{{22}}\.{_B64}{{43}}"),
    Rule("npm", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}"),
    Rule("jwt", rf"(?<![A-Za-z0-9_-])eyJ{_B64}{{10,}}\.eyJ{_B64}{{10,}}\.{_B64}{{20,}}"),
    Rule("pem", r"-----BEGIN (?P<pem>(?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?)-----[^-]+-----END (?P=pem)-----"),
    Rule("bearer", r"(?<![A-Za-z])[Bb]earer\x20+[A-Za-z0-9._~+/-]{24,}=*"),
    Rule("url_login", r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]+://[^\s/?#:@]+:[^\s/?#@]{3,}@"),
)
RULES = BASE + MORE
#: Characters of text in a block of the index.
BLOCK = 1 << 21


def verify(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_block(texts: list[str], rules: tuple[Rule, ...], queries: list, wanted, patterns: list[re.Pattern]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rank of the kind, end), sorted."""
    index, found = Index(texts, wanted), [[] for _ in texts]
    for rank, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
        for i in index.search(query).tolist():
            found[i].extend((s, rank, e) for s, e in verify(rule, pattern, texts[i]))
    return [sorted(f) for f in found]


def _scanning(rule: Rule) -> re.Pattern:
    """The rule's expression; a greedy run of one class is told to be long enough as it is found."""
    run = re.fullmatch(r"(\[[^]\\]+\])\+", rule.pattern)
    return re.compile(f"(?<!{run[1]}){run[1]}{{{rule.least},}}" if run and rule.group == 0 else rule.pattern, rule.flags)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array of {kind, rank, start, end}, by start then rank): a row per row of ``docs``."""
    small_batches(docs.sparkSession)
    kinds = [r.kind for r in rules]

    def run(batches):
        queries = [r.query for r in rules]
        wanted, patterns = dictionary(queries), [_scanning(r) for r in rules]

        def done(ids, texts):
            spans = [[{"kind": kinds[k], "rank": k, "start": s, "end": e} for s, k, e in x] for x in scan_block(texts, rules, queries, wanted, patterns)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind)], names=["id", "spans"])

        for x in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(t or "")
                if size >= BLOCK:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, spans array<struct<kind: string, rank: int, start: int, end: int>>")


def op1_secrets_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
