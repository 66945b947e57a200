"""Admission gates: grounding, novelty, poisoning, attribution, egress, opt-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body, distinctive, is_directive, normalized_path

GROUNDED, FEW_EVENTS, NOVEL, TOP, SHARED = 0.10, 5, 0.6, 3, 2


def grounding(content: Column, source: Column) -> Column:
    """Share of a note's tokens that its source has; 1 without a source or tokens."""
    mine, theirs = distinctive(body(content)), distinctive(source)
    blank = F.trim(F.coalesce(source, F.lit(""))) == ""
    return F.when(blank | (F.size(mine) == 0), 1.0).otherwise(F.size(F.array_intersect(mine, theirs)) / F.greatest(F.size(mine), F.lit(1)))


def _hashes(text: Column) -> Column:
    """The distinct tokens as numbers, which are cheaper to shuffle than words."""
    return F.transform(distinctive(text), lambda t: F.xxhash64(t))


def grounding_of(notes: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``notes`` (key, content) with ``grounding`` in the source (key, source) of the same key: as
    ``grounding``, but only tokens' hashes are shuffled, never texts."""
    mine = notes.withColumn("_mine", _hashes(body(F.col("content")))).drop("content")
    theirs = sources.select(key, _hashes(F.col("source")).alias("_theirs"), (F.trim(F.coalesce("source", F.lit(""))) == "").alias("_blank"))
    share = F.size(F.array_intersect("_mine", "_theirs")) / F.greatest(F.size("_mine"), F.lit(1))
    met = mine.join(theirs, key)
    return met.withColumn("grounding", F.when(F.col("_blank") | (F.size("_mine") == 0), 1.0).otherwise(share)).drop("_mine", "_theirs", "_blank")


def novelty(notes: DataFrame, corpus: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, novelty): 1 less the share of a note's tokens that occur in the corpus.

    As a join on tokens: the corpus's distinct tokens are never gathered into one value.
    """
    one = F.lit(0).alias("_one")
    return novelty_by(notes.select(key, text, one), corpus.select(text, one), "_one", key, text)


def found_by(notes: DataFrame, corpus: DataFrame, group: str, key: str = "path", text: str = "content") -> DataFrame:
    """(key, n, k): how many tokens a note has, and how many of them the texts of its own group have."""
    mine = notes.select(key, group, F.explode_outer(_hashes(body(F.col(text)))).alias("token"))
    known = corpus.select(group, F.explode(_hashes(F.col(text))).alias("token")).distinct().withColumn("seen", F.lit(1))
    return mine.join(known, [group, "token"], "left").groupBy(key).agg(F.count("token").alias("n"), F.count("seen").alias("k"))


def novelty_by(notes: DataFrame, corpus: DataFrame, group: str, key: str = "path", text: str = "content") -> DataFrame:
    """``novelty``, each note against the texts of its own group."""
    by = found_by(notes, corpus, group, key, text)
    return by.select(key, F.when(F.col("n") == 0, 0.0).otherwise(1 - F.col("k") / F.greatest("n", F.lit(1))).alias("novelty"))


def novelty_among(notes: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, novelty) of every note against all others: a token counts as known if another note has it."""
    mine = notes.select(key, _hashes(body(F.col(text))).alias("_t"))
    n = mine.select(F.explode("_t").alias("token")).groupBy("token").agg(F.count("*").alias("n_notes"))
    lone = mine.select(key, F.explode("_t").alias("token")).join(n.where("n_notes = 1"), "token", "left_semi").groupBy(key).agg(F.count("*").alias("_lone"))
    share = F.coalesce("_lone", F.lit(0)) / F.greatest(F.size("_t"), F.lit(1))
    return mine.join(lone, key, "left").select(key, F.when(F.size("_t") == 0, 0.0).otherwise(share).alias("novelty"))


def poisoning(content: Column, n_events: Column, novelty_: Column, novel: float = NOVEL) -> Column:
    """A directive from a thin source that nothing known supports: only all three together."""
    return is_directive(content) & (n_events < FEW_EVENTS) & (novelty_ >= novel)


def attribution(notes: DataFrame, events: DataFrame, k: int = TOP, least: int = SHARED) -> DataFrame:
    """For each note of a session the events that share the most tokens with it.

    Notes (path, session_key, content) and events (event_id, session_key, seq, body) meet on session
    and token, never all against all.
    """
    a = notes.select("path", "session_key", F.explode(distinctive(F.col("content"))).alias("token"))
    b = events.select("event_id", "seq", "session_key", F.explode(distinctive(F.col("body"))).alias("token"))
    both = a.join(b, ["session_key", "token"]).groupBy("path", "event_id", "seq").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)
    order = Window.partitionBy("path").orderBy(F.desc("n_shared"), "seq")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seq")


def under(cwd: Column, prefixes: list[str]) -> Column:
    """Whether a folder is one of the configured ones or below it."""
    at, out = normalized_path(cwd), F.lit(False)
    for p in prefixes:
        p = p.replace("\\", "/").lower().rstrip("/")
        out = out | (at == p) | F.startswith(at, F.lit(p + "/"))
    return F.coalesce(out, F.lit(False))


def without_optouts(event: DataFrame, prefixes: list[str]) -> DataFrame:
    return event.where(~under(F.col("cwd"), prefixes))


def sensitivity(cwd: Column, prefixes: list[str]) -> Column:
    return F.when(under(cwd, prefixes), "high").otherwise("normal")


def egress_blocked(provider: Column, sensitive: Column, allowed: Column, remote: tuple[str, ...] = ("anthropic", "openai")) -> Column:
    return provider.isin(*remote) & sensitive & ~allowed


def path_list(lines: list[str], setting: str = "") -> list[str]:
    """Folders of a setting (divided by ;) and of a file's lines (# begins a comment)."""
    rows = [*setting.split(";"), *(x.split("#", 1)[0] for x in lines)]
    return [x.strip() for x in rows if x.strip()]


def projects(cwds: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (..., cwd) with ``project``: the last segment of the longest root (a table ``root``) that the
    folder is or lies below, else of the folder. An equality join on the folder's own ancestors."""
    at = normalized_path(F.col("cwd"))
    parts = F.split(at, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    known = roots.select(normalized_path(F.col("root")).alias("_root")).distinct()
    seen = cwds.select("cwd").distinct()
    best = seen.select("cwd", F.explode(up).alias("_root")).where("_root <> ''").join(known, "_root").groupBy("cwd").agg(F.max_by("_root", F.length("_root")).alias("_root"))
    return cwds.join(best, "cwd", "left").withColumn("project", F.nullif(F.substring_index(F.coalesce("_root", at), "/", -1), F.lit(""))).drop("_root")
