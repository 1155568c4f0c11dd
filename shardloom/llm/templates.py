"""Line dedup by a tree of line templates, with DataFrame operations only.

The tree has a fixed depth: a line's number of tokens, then its leading tokens, lead to a leaf; tokens with a digit are
variable fields. In a leaf, lines are taken in the order of documents: a line belongs to the earliest leader with which it
agrees in enough places, and the places in which the lines of a leader differ are variable fields; a line that agrees with
no earlier leader is a leader itself. A template that occurs in several documents is dropped from all but the first.
Lines with fewer tokens than a template needs recur only as they are (but for fields), in more documents.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import WORD, bind, cut, stored

#: Leading tokens in the tree; tokens of a line that a template needs; share of places in which lines of a template agree.
DEPTH, LEAST, ALIKE = 3, 5, 0.7
#: Documents in which a line of fewer tokens recurs if it is to go.
SHORT_DOCS = 5
#: Lines of a key that are compared with each other; of more, a leader takes its followers or the key is made finer.
FEW_LINES = 64
#: Lines up to which every set of places that suffices to agree has a key of its own (15 sets for 9 tokens).
SHORT = 9
FIELD = "<*>"
#: Rows up to which a table of leaves (8 bytes each) is broadcast.
SMALL = 400_000


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _parsed(line: Column, with_text: bool) -> Column:
    """A struct (n, leaf, line) of a line: its tokens, and hashes of its place in the tree and of its masked text; and the
    text itself, tokens with single blanks and fields masked. Most lines have single blanks and no digit already."""
    odd = line.startswith(" ") | line.endswith(" ")
    for blanks in ("  ", "\t", "\r", "\x0b", "\x0c"):  # cheaper than one pattern
        odd |= line.contains(blanks)
    plain = F.when(odd, F.array_join(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), " ")).otherwise(line)
    masked = lambda p: F.when(p.rlike("[0-9]"), F.regexp_replace(p, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", FIELD)).otherwise(p)
    count = lambda m: F.when(m == "", 0).otherwise(F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1)
    hashes = lambda m, n: [F.xxhash64(n, F.substring_index(m, " ", DEPTH)).alias("leaf"), F.xxhash64(m).alias("line"), *([m.alias("masked")] if with_text else [])]
    return bind(plain, lambda p: bind(masked(p), lambda m: bind(count(m), lambda n: F.struct(n.alias("n"), *hashes(m, n)))))


def _lines(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Lines with tokens: id, rid, pos, n, leaf, line (see ``_parsed``). ``rid`` is a hash of id and text. Each line is
    parsed once, inside its document's array, where no filter pushed down repeats the work."""
    parsed = F.transform(F.split("text", "\n"), lambda x: _parsed(x, with_text))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rid"), F.posexplode(parsed).alias("pos", "v"))
    return rows.select("id", "rid", "pos", "v.*").where("n > 0")


def enough(n: Column | int):
    """Places in which a line of n tokens must agree with its leader, the leading ones included."""
    return -(-round(n * ALIKE * 10**6) // 10**6) if isinstance(n, int) else F.ceil(F.round(n * ALIKE, 6)).cast("int")


def _block(b: Column, size: Column, blocks: Column) -> tuple[Column, Column]:
    """The first and the last + 1 of the places of block ``b`` of ``size`` places."""
    return F.floor(b * size / blocks).cast("int"), F.floor((b + 1) * size / blocks).cast("int")


def _first_keys(tokens: DataFrame) -> DataFrame:
    """(at, key, b, places, full) such that two lines of a leaf share a key if they agree in enough places.

    Up to SHORT tokens: every set of places that is enough, so that lines share a key exactly if they agree (``full``).
    Longer lines: blocks of places, one more than there may be differing places; ``b`` is the block.
    """
    n, keys = F.col("n"), F.col("keys")
    size = F.size(keys)
    part = lambda b, m: F.slice(keys, _block(b, size, m)[0] + 1, _block(b, size, m)[1] - _block(b, size, m)[0])
    blocks = bind(F.least(n - enough(n) + 1, size), lambda m: F.transform(F.sequence(F.lit(0), m - 1), lambda b: F.xxhash64("leaf", b, part(b, m))))
    for k in range(LEAST, SHORT + 1):
        sets = list(combinations(range(k - DEPTH), enough(k) - DEPTH))
        blocks = F.when(n == k, F.array(*[F.xxhash64("leaf", F.lit(c), *[F.get(keys, F.lit(i)) for i in places]) for c, places in enumerate(sets)])).otherwise(blocks)
    out = tokens.select("at", (n <= SHORT).alias("full"), F.posexplode(blocks).alias("b", "key"))
    return out.select("at", "key", "b", F.lit(None).cast("array<int>").alias("places"), "full")


def _finer(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Keys of more places for lines that share a key: of the places that the key leaves out, blocks as in ``_first_keys``."""
    rows = rows.join(own, "at")
    n, keys = F.col("n"), F.col("keys")
    size, most = F.size(keys), n - enough(n) + 1
    low, high = _block(F.col("b"), size, F.least(most, size))
    rows = rows.withColumn("places", F.coalesce("places", F.sequence(low, high - 1)))
    rows = rows.withColumn("rest", F.array_except(F.sequence(F.lit(0), size - 1), "places")).withColumn("m", F.least(most, F.size("rest")))
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    low, high = _block(F.col("b"), F.size("rest"), F.col("m"))
    rows = rows.withColumn("places", F.array_sort(F.concat("places", F.slice("rest", low + 1, high - low))))
    key = F.xxhash64("leaf", "places", F.transform("places", lambda i: F.get(keys, i)))
    return rows.select("at", key.alias("key"), "b", "places", (F.size("places") >= enough(n) - DEPTH).alias("full"), "follows").dropDuplicates(["at", "key"])


def _agreeing(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of the pairs (at, head, known) that agree; ``known`` says that they do."""
    theirs = own.select(F.col("at").alias("head"), F.col("keys").alias("theirs"), F.col("doc").alias("their_doc"))
    agree = F.size(F.filter(F.zip_with("keys", "theirs", lambda a, b: a == b), lambda x: x)) + DEPTH
    both = pairs.join(own, "at").join(theirs, "head")
    return both.where(F.col("known") | (agree >= enough(F.col("n")))).drop("keys", "theirs", "n", "leaf")


def _by_agreement(tokens: DataFrame) -> DataFrame:
    """Rows (leaf, line, mask, first, last) of the lines that share a template: ``mask`` is a leader's ``line``.
    ``tokens``: leaf, line, n, keys, first (the line's first place, by which lines are ordered) and last.

    Taken one after the other, a line leads if it agrees with no earlier leader. So a line that is the earliest in all its keys leads,
    all others that agree with it follow, and both leave; rounds of this give the leaders. A round takes many leaders at once, in any
    number of keys, and its keys don't shrink line by line: once a key has few lines, those that agree are a key of
    their own and the others part, and a key of which a leader took less than half has lines that are unlike, so it is made finer, until
    what shares it agrees. A line belongs to the earliest leader with which it agrees. That leader matters only if it is of
    the line's own first document, which would keep the line: such a follower stays, without ever leading, until its keys are done.
    """
    tokens = tokens.groupBy("leaf", "line").agg(F.min(F.struct("first", "last", "n", "keys")).alias("t")).orderBy("t.first")
    tokens = stored(tokens.select(F.monotonically_increasing_id().alias("at"), "leaf", "line", "t.*"))  # numbers in the order of first places
    own = tokens.select("at", "leaf", "n", "keys", F.col("first.rid").alias("doc"))
    live = _first_keys(tokens).withColumns({"follows": F.lit(False), "before": F.lit(None).cast("long")})
    joined: list[DataFrame] = []
    parted = True
    while True:
        heads = live.groupBy("key").agg(F.min(F.when(~F.col("follows"), F.col("at"))).alias("head"), F.max("at").alias("end"), F.count(F.lit(1)).alias("lines"))
        live = stored(live.join(heads.where("head < end").drop("end"), "key").where("at >= head"))
        if live.isEmpty():
            break
        few = F.col("lines") <= FEW_LINES
        part = ~F.col("full") & F.when(few, F.lit(len(joined) > 0)).otherwise(F.coalesce(2 * F.col("lines") > F.col("before"), F.lit(False)))
        if not parted and not live.where(part).isEmpty():
            some = live.where(part & few)
            earlier = some.where(~F.col("follows")).select("key", F.col("at").alias("head"))
            pairs = some.select("key", "at", "follows").join(earlier, "key").where("head < at").groupBy("at", "head").agg(F.first("follows").alias("follows"), F.lit(False).alias("known"))
            ends = F.array(F.struct("at", "follows"), F.struct(F.col("head").alias("at"), F.lit(False).alias("follows")))
            pairs = _agreeing(pairs, own).select(F.xxhash64(F.lit("pair"), "at", "head").alias("key"), F.explode(ends).alias("end")).select("end.at", "key", F.lit(0).alias("b"), F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("full"), "end.follows")
            finer = _finer(live.where(part & ~few).select("at", "key", "b", "places", "follows"), own)
            rest = live.where(~part).select(*pairs.columns, "before")
            live, parted = rest.unionByName(pairs.unionByName(finer).withColumn("before", F.lit(None).cast("long"))), True
            continue
        leaders = cut(live.where(~F.col("follows")).groupBy("at").agg(F.min("head").alias("head")).where("at = head").select("head"))
        pairs = live.join(leaders, "head", "left_semi").where("at <> head").groupBy("at", "head").agg(F.max("full").alias("known"))
        found = cut(_agreeing(pairs, own).groupBy("at").agg(F.min(F.struct("head", "their_doc")).alias("h"), F.first("doc").alias("doc")).select("at", "h.head", (F.col("doc") == F.col("h.their_doc")).alias("stays")))
        joined.append(found.select("at", "head"))
        gone = leaders.select(F.col("head").alias("at")).unionByName(found.where(~F.col("stays")).select("at"))
        left = live.join(gone, "at", "left_anti").join(leaders.select("head", F.lit(True).alias("led")), "head", "left").join(found.where("stays").select("at", "stays"), "at", "left")
        follows = F.col("follows") | F.coalesce("stays", F.lit(False))
        live, parted = left.select("at", "key", "b", "places", "full", follows.alias("follows"), F.when(F.col("led"), F.col("lines")).alias("before")), False
    if not joined:
        return tokens.limit(0).select("leaf", "line", F.col("line").alias("mask"), "first", "last")
    every = joined[0]
    for found in joined[1:]:
        every = every.unionByName(found)
    every = every.groupBy("at").agg(F.min("head").alias("head"))
    every = every.unionByName(every.select(F.col("head").alias("at"), "head").distinct())
    every = every.join(tokens.select("at", "leaf", "line", "first", "last"), "at").join(tokens.select(F.col("at").alias("head"), F.col("line").alias("mask")), "head")
    return every.select("leaf", "line", "mask", "first", "last")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """Rows (id, rid, drops): the positions of a document's lines of which an earlier document has the template."""
    every = stored(_lines(docs).select("id", "rid", "pos", (F.col("n") < LEAST).alias("short"), "leaf", "line"))
    lines, owner = every.where("not short"), F.struct("id", "rid", "pos")
    exact = stored(lines.groupBy("leaf", "line").agg(F.min(owner).alias("first"), F.max(F.struct("id", "rid")).alias("last")))
    mixed = exact.groupBy("leaf").count().where("count > 1").select("leaf")
    shown = stored(exact.join(mixed, "leaf", "left_semi").select("first.rid", "first.pos", "leaf", "line", "last"))
    texts, holders = docs.select("doc_id", "text"), cut(shown.select("rid").distinct())
    if holders.limit(SMALL + 1).count() <= SMALL:  # else all documents are parsed again, with the same result
        texts = texts.join(F.broadcast(holders), F.xxhash64("doc_id", "text") == holders["rid"], "left_semi")
    tokens = _lines(texts, with_text=True).where(F.col("n") >= LEAST).join(_maybe_broadcast(cut(mixed)), "leaf", "left_semi").join(shown, ["rid", "pos", "leaf", "line"])
    keys = F.transform(F.split("masked", " "), lambda t: F.xxhash64(t))
    # a leaf's lines agree in the leading tokens, so only those after them are compared
    tokens = tokens.select("leaf", "line", "n", F.slice(keys, F.lit(DEPTH + 1), F.col("n") - DEPTH).alias("keys"), owner.alias("first"), "last")
    members = stored(_by_agreement(tokens))
    groups = members.groupBy("leaf", "mask").agg(F.min("first").alias("group_first"), F.max("last").alias("group_last")).where("group_first.rid <> group_last.rid")
    shared = members.join(groups, ["leaf", "mask"]).select("leaf", "line", F.col("group_first.rid").alias("keeper"))
    alone = exact.where("first.rid <> last.rid").join(members, ["leaf", "line"], "left_anti").select("leaf", "line", F.col("first.rid").alias("keeper"))
    # of short lines with as many places, those with as many documents
    often = every.where("short").groupBy("leaf", "line").count().where(F.col("count") >= SHORT_DOCS).select("leaf", "line")
    often = every.where("short").join(_maybe_broadcast(cut(often)), ["leaf", "line"], "left_semi").groupBy("leaf", "line", "id", "rid").agg(F.lit(1).alias("one"))
    often = often.groupBy("leaf", "line").agg(F.count("one").alias("docs"), F.min(F.struct("id", "rid")).alias("first")).where(F.col("docs") >= SHORT_DOCS).select("leaf", "line", F.col("first.rid").alias("keeper"))
    recurring = stored(alone.unionByName(shared).unionByName(often))
    # the occurrences of a very common line are one skewed partition of this join, which adaptive execution splits
    found = every.join(recurring, ["leaf", "line"]).where("rid <> keeper").select("id", "rid", "pos")
    return cut(found.groupBy("id", "rid").agg(F.sort_array(F.collect_set("pos")).alias("drops")))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its recurring lines, and the columns ``n_lines`` and ``n_dropped`` (long).

    Lines are parts between ``\\n``; those without tokens always stay. Recurring means in two documents or more (lines of fewer
    than LEAST tokens: as they are but for fields, in SHORT_DOCS or more), documents being different pairs of id and text; the
    document with the smallest id (null before all) keeps its lines. A null text stays null and has no lines, an empty one has one. Repeated rows are one document and all stay. A
    line's order and blanks stay as they are. An empty table gives no rows. Other columns stay as they are, but ``n_lines``
    and ``n_dropped`` of ``docs`` are replaced. Texts of any length are parsed whole.
    """
    docs = docs.drop("n_lines", "n_dropped")
    drops = dropped_lines(docs).select(F.col("id").alias("__id"), F.col("rid").alias("__rid"), F.col("drops").alias("__drops"))
    rows = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    rows = rows.join(drops, (F.col("__key") == F.col("__rid")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    parts = F.split("text", "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("__drops"), i)), "\n")
    rows = rows.withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.size("__drops"), F.lit(0)).cast("long"))
    rows = rows.withColumn("text", F.when(F.col("__drops").isNull(), F.col("text")).otherwise(left))
    return rows.select(*docs.columns, "n_lines", "n_dropped")
