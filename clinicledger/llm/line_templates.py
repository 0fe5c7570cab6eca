"""Operator 6: line dedup by a log-template tree of fixed depth.

A line's tokens are its white-space separated words; a token with a digit is a
variable field and becomes ``<*>``.  The tree has two levels of keys: the
number of tokens, then the first ``DEPTH`` tokens.  In a leaf the lines vote
position by position (each distinct masked line once): a token with at least
``AGREE`` of the leaf's lines is constant, any other position is a variable
field.  If at least ``CONSTANT`` of the positions are constant, the leaf has a
template, and lines that have all its constant tokens belong to it.  Lines
that belong to none are their own (masked) template.

With ``several`` a leaf also holds a template per set of best supported
tokens: each line keeps the least number of tokens that makes ``CONSTANT`` of
its positions, those that most lines of the leaf share at their position, and
lines that keep the same ones are a template.  Unrelated lines and other
templates in the leaf take no vote from it.  A line may then belong to two
templates, and goes if one of them recurs.

A template that recurs in at least ``min_docs`` documents is dropped: all its
lines are taken out of all documents (with ``keep_first``, of all but the
document with the smallest doc_id).  Lines under ``min_tokens`` tokens stay.

DataFrame operations only.  Lines are counted by hashes; texts move once, for
the documents that lose lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicledger.llm.common import small, stored

DEPTH, AGREE, CONSTANT = 4, 0.5, 0.6
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The line's tokens joined by single spaces, variable fields masked.
    Patterns run only on lines that a plain search has found something in."""
    odd = F.lit(False)
    for gap in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | F.contains(line, F.lit(gap))
    clean = F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))
    return _let(clean, lambda c: F.when(
        c.rlike("[0-9]"), F.regexp_replace(c, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")
    ).otherwise(c))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _lines(docs: DataFrame, with_text: bool) -> DataFrame:
    """Each line that isn't blank: ``doc_id``, ``th``, ``pos``, ``line``
    (hash of the masked line), ``n``, ``leaf``, and ``masked`` if asked for.
    All of it is computed inside the generator, once per line."""
    def parts(m: Column) -> Column:
        return F.when(m != "", _let(F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1, lambda n: F.struct(
            F.xxhash64(m).alias("line"), n.alias("n"), F.xxhash64(n, F.substring_index(m, " ", DEPTH)).alias("leaf"),
            *([m.alias("masked")] if with_text else []),
        )))

    lines = F.transform(F.split("text", "\n"), lambda x: _let(masked(x), parts))
    rows = docs.select("doc_id", "th", F.posexplode(lines).alias("pos", "l"))
    return rows.filter("l is not null").select("doc_id", "th", "pos", "l.*")


def _many(rows: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Keys on at least ``min_docs`` documents (distinct pairs combine before
    the shuffle; a hot key's pairs are spread by document)."""
    return rows.select(key, "doc_id", "th").distinct().groupBy(key).agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)


def _best_supported(texts: DataFrame, votes: DataFrame) -> DataFrame:
    """``line``, ``template`` of the lines that share their best supported
    tokens with another line.  A leaf's first ``DEPTH`` tokens are common to
    its lines, so only later ones are looked up."""
    place = lambda leaf, at, token: F.xxhash64(leaf, at, token).alias("place")
    shared = votes.filter((F.col("c") > 1) & (F.col("token") != FIELD) & (F.col("at") >= DEPTH))
    shared = small(stored(shared.select(place("leaf", "at", "token"), "c"), "shared-tokens"))
    head = F.size(F.filter(F.slice("tokens", 1, DEPTH), lambda t: t != FIELD))
    need = F.greatest(F.ceil(CONSTANT * F.col("n")).cast("int") - head, F.lit(0)).alias("need")
    later = F.posexplode(F.slice("tokens", DEPTH + 1, F.col("n"))).alias("at", "token")
    places = texts.select("leaf", "line", need, later).filter(F.col("token") != FIELD)
    places = places.select("leaf", "line", "need", place("leaf", F.col("at") + DEPTH, "token"))
    own = places.join(shared, "place").groupBy("leaf", "line", "need").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "place"))).alias("own")
    )
    none = texts.select("leaf", "line", need).filter("need = 0")
    kept = own.filter((F.col("need") > 0) & (F.size("own") >= F.col("need"))).select(
        "line", F.xxhash64("leaf", F.array_sort(F.transform(F.slice("own", 1, F.col("need")), lambda o: o["place"]))).alias("template")
    ).union(none.select("line", F.xxhash64("leaf", F.lit("head")).alias("template")))
    kept = stored(kept, "best-supported")
    common = kept.groupBy("template").agg(F.count("*").alias("c")).filter("c > 1").select("template")
    return kept.join(common, "template").select("line", "template")


def recurring(
    docs: DataFrame, min_docs: int = 5, min_tokens: int = 3, keep_first: bool = False, several: bool = False
) -> DataFrame:
    """``doc_id``, ``th`` (hash of the text) and ``gone``, the sorted numbers
    of the lines to drop, for every distinct document that loses some."""
    coded = stored(_lines(docs, False).filter(F.col("n") >= min_tokens), "lines")
    busy = coded.groupBy("leaf").agg(F.count("*").alias("c"), F.min("line").alias("x"), F.max("line").alias("y"))
    busy = stored(busy.filter(F.col("c") >= min_docs).select("leaf", (F.col("x") != F.col("y")).alias("mixed")), "leaves")
    near = stored(coded.join(small(busy), "leaf"), "near-lines")

    # leaves with different lines: tokens vote at each position
    mixed = small(stored(busy.filter("mixed").select("leaf"), "mixed"))
    texts = (
        _lines(docs, True).filter((F.col("n") >= min_tokens) & (F.col("n") > DEPTH)).join(mixed, "leaf")
        .groupBy("leaf", "n", "line").agg(F.first("masked").alias("masked"))
    )
    texts = stored(texts.select("leaf", "n", F.split("masked", " ").alias("tokens"), "line"), "leaf-lines")
    votes = texts.select("leaf", "n", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "n", "at", "token").agg(
        F.count("*").alias("c")
    )
    votes = stored(votes, "votes") if several else votes
    winners = votes.groupBy("leaf", "n", "at").agg(
        F.max(F.struct("c", "token")).alias("top"), F.sum("c").alias("all")
    ).filter((F.col("top.c") >= AGREE * F.col("all")) & (F.col("top.token") != FIELD))
    templates = winners.groupBy("leaf", "n").agg(
        F.collect_list(F.struct("at", F.col("top.token").alias("token"))).alias("constant")
    ).filter(F.size("constant") >= CONSTANT * F.col("n")).drop("n")
    fits = F.forall("constant", lambda c: F.element_at("tokens", c["at"] + 1) == c["token"])
    members = texts.join(templates, "leaf").filter(fits).select("line", F.col("leaf").alias("template"))
    members = stored(members.union(_best_supported(texts, votes)) if several else members, "members")

    named = near.join(small(members), "line", "left").withColumn("template", F.coalesce("template", "line"))
    named = stored(named.select("doc_id", "th", "pos", "template"), "templated")
    gone = stored(_many(named, "template", min_docs).select("template"), "recurring")
    hits = named.join(small(gone), "template")
    if keep_first:
        first = hits.groupBy("template").agg(F.min(F.struct("doc_id", "th")).alias("first"))
        hits = hits.join(first, "template").groupBy("doc_id", "th", "pos").agg(
            F.bool_or(F.struct("doc_id", "th").eqNullSafe(F.col("first"))).alias("kept")
        ).filter("not kept")
    return hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = 5, min_tokens: int = 3, keep_first: bool = False, several: bool = False
) -> DataFrame:
    """``docs`` with ``text`` without the lines of recurring templates,
    ``n_lines`` (before) and ``n_dropped``.

    Null texts stay null with 0 lines; a document may lose all lines (empty
    text).  Rows with equal doc_id and text count as one document and get
    equal results.  Input columns ``n_lines`` and ``n_dropped`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    source = docs.select(*names).withColumn("text", F.col("text").cast("string")).withColumn("__th", F.xxhash64("text"))
    found = recurring(
        source.filter("text is not null").select("doc_id", F.col("__th").alias("th"), "text"), min_docs, min_tokens, keep_first, several
    ).select(F.col("doc_id").alias("__id"), F.col("th").alias("__t"), F.col("gone").alias("__gone"))
    found = stored(found, "gone-lines")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__t"))
    lines = F.split("text", "\n")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(F.col("__lines"), i)
    )
    out = source.join(found, same, "left").withColumn("__lines", lines)
    return out.select(
        *[F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")).alias(c) if c == "text"
          else F.col(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_dropped"),
    )
