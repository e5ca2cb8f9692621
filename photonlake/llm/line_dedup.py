"""Line deduplication across documents by a segment-partition edit join, in DataFrame operations only.

Equal lines collapse by a 128-bit hash. Lines within a small edit distance are found by the pigeonhole
principle: a line of length l is cut into t + 1 segments (t edits allowed at that length), and any line
within t edits holds one of them unchanged, shifted by no more than what the lengths and the segment's rank
allow. So each line posts its own segments under (its length, rank, content) and probes with the few
substrings that could equal a segment of a line as long or up to t shorter. Only keys and hashes are shuffled;
the texts of lines that meet are fetched afterwards.

Lists that many lines share (a template's segment) are refined: what the segment leaves of a line on its left
and right holds all the edits, so it is cut into t + 1 pieces, of which one again is unchanged. Lists that are
still long are compared with one of their lines first, which connects those alike, and then in blocks of members
of which only links leave a task.

Lines that meet are verified by a banded bit-parallel automaton: bit d of word e tells whether the diagonal d of
the band is reached with e edits, and one step of all diagonals takes a few operations on whole words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.llm.columns import let
from photonlake.llm.components import components
from photonlake.llm.storage import Scratch

#: White space that does not count at the ends of a line.
_BLANK = " \t\r\x0b\x0c"
#: Edits at most, and the mask of the band's diagonals.
_EDITS = 2
_BAND = (1 << 2 * _EDITS + 1) - 1


def common_start(a: Column, b: Column) -> Column:
    """Length of the common prefix, up to 2^21 - 1 characters."""
    powers = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when((n + p <= F.least(F.char_length(a), F.char_length(b))) & (F.left(a, n + p) == F.left(b, n + p)), n + p).otherwise(n))


def edits(a: Column, b: Column) -> Column:
    """Edit distance of two strings if it is at most two, else 3."""
    rest = lambda s, start: F.substring(s, start + 1, F.char_length(s))
    both = lambda start: F.struct(rest(a, start).alias("x"), rest(b, start).alias("y"), F.reverse(rest(a, start)).alias("rx"), F.reverse(rest(b, start)).alias("ry"))
    chars = lambda s, end: F.filter(F.split(F.left(s, F.char_length(s) - end), ""), lambda c: c != "")
    inner = lambda m: let(common_start(m["rx"], m["ry"]), lambda end: let(F.struct(chars(m["x"], end).alias("x"), chars(m["y"], end).alias("y")), _automaton))
    return let(common_start(a, b), lambda start: let(both(start), inner))


#: Groups of letters whose numbers are compared first.
_LETTERS = ("ae", "io", "un", "st", "rl", "dm", "ch")


def letter_counts(line: Column) -> Column:
    """How many characters of each group a line has, and how many others; an edit changes two of the numbers by one at most."""
    left = [F.char_length(F.translate(line, group, "")) for group in _LETTERS]
    return F.array(*[F.char_length(line) - n for n in left], F.char_length(F.translate(line, "".join(_LETTERS), "")))


def _side(texts: DataFrame, side: str) -> DataFrame:
    return texts.select(F.col("h").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("line", "len", "letters")])


def _automaton(m: Column) -> Column:
    x, y = m["x"], m["y"]
    state = lambda at, words: F.struct(at.alias("at"), *[w.alias(f"r{e}") for e, w in enumerate(words)])

    def step(s: Column, c: Column) -> Column:
        def moved(equal: Column) -> Column:
            words = [s["r0"].bitwiseAND(equal)]
            for e in range(1, _EDITS + 1):
                old = s[f"r{e - 1}"]
                word = s[f"r{e}"].bitwiseAND(equal).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
                words.append(word.bitwiseAND(F.lit(_BAND)))
            return state(s["at"] + 1, words)

        equal = sum((F.when(F.get(x, s["at"] + d - _EDITS) == c, 1 << d).otherwise(0) for d in range(2 * _EDITS + 1)), F.lit(0))
        return F.when(s[f"r{_EDITS}"] == 0, s).otherwise(let(equal, moved))

    begin = state(F.lit(0), [F.lit(sum(1 << _EDITS + k for k in range(e + 1))) for e in range(_EDITS + 1)])
    apart = F.size(x) - F.size(y)
    reached = lambda s, e: F.getbit(s[f"r{e}"], F.least(F.greatest(apart + _EDITS, F.lit(0)), F.lit(2 * _EDITS))) == 1
    last = F.aggregate(y, begin, step, lambda s: F.when(reached(s, 0), 0).when(reached(s, 1), 1).when(reached(s, 2), 2).otherwise(3))
    return F.when(F.abs(apart) > _EDITS, 3).otherwise(last)


class LineDedup:
    """Keep the first occurrence of each group of equal or nearly equal lines.

    A line of ``two_from`` characters or more may differ by two edits, from ``one_from`` on by one, a shorter
    one by none; the shorter line of a pair decides. Groups are the components of these links. Of a group
    with at least ``least`` occurrences in all documents the first stays (smallest doc_id, nulls last, then
    line number) and the others go; smaller groups and blank lines stay. White space at the ends of a line
    is passed over in comparisons. A null text stays null; an empty one stays empty. Rows that repeat a
    doc_id are told apart by their texts; equal ones share their decisions.
    """

    def __init__(self, spark: SparkSession, least: int = 2, one_from: int = 24, two_from: int = 64, long_list: int = 24, block: int = 512):
        self.spark, self.least, self.one_from, self.two_from, self.long_list, self.block = spark, least, one_from, two_from, long_list, block
        self.scratch = Scratch(spark, "line-dedup")

    def run(self, docs: DataFrame) -> DataFrame:
        """The columns of ``docs`` with ``text`` deduplicated, and ``n_lines`` and ``removed_lines`` (numbers from 0), which replace columns of these names."""
        names = [c for c in docs.columns if c not in ("text", "n_lines", "removed_lines")]
        keyed = docs.select(F.col("doc_id").alias("k_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k_at"), F.col("text").alias("k_text"), F.struct(*[docs[c] for c in names]).alias("k_row"))
        removed = self.removals(docs)
        joined = keyed.join(removed, keyed.k_doc.eqNullSafe(removed.r_doc) & (keyed.k_at == removed.r_at), "left")
        gone = F.coalesce(removed.r_removed, F.expr("cast(array() as array<int>)"))
        lines = F.split("k_text", "\n")
        text = F.when(F.size(gone) == 0, F.col("k_text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n"))
        return joined.select(*[F.col("k_row")[c].alias(c) for c in names], text.alias("text"), F.when(F.col("k_text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), gone.alias("removed_lines"))

    def removals(self, docs: DataFrame) -> DataFrame:
        """(r_doc, r_at, r_removed): the line numbers that go from each row that loses any."""
        lines = self._lines(docs)
        seen = self.scratch.table(lines.select("doc", "at", "no", "h", "g", "len"), "occurrences")
        place = F.struct(F.col("doc").isNull().alias("last"), "doc", "at", "no")
        classes = self.scratch.table(seen.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.max("len").alias("len")), "classes")
        links = self._links(docs, classes)
        near = components(links, self.scratch, "lines")
        groups = classes.join(near, classes.h == near.node, "left").select("h", "g", "first", "times", F.coalesce("component", "h").alias("group"), F.when(F.col("component").isNull(), F.col("g")).alias("own"))
        whole = groups.groupBy("group", "own").agg(F.min("first").alias("stays"), F.sum("times").alias("all"))
        repeated = whole.filter((F.col("all") >= self.least) & (F.col("all") > 1))
        decided = groups.join(repeated, groups.group.eqNullSafe(repeated.group) & groups.own.eqNullSafe(repeated.own)).select("h", "g", "stays")
        gone = seen.join(decided, ["h", "g"]).filter(~place.eqNullSafe(F.col("stays")))
        return self.scratch.table(gone.groupBy(F.col("doc").alias("r_doc"), F.col("at").alias("r_at")).agg(F.array_sort(F.collect_set("no")).alias("r_removed")), "removed")

    @staticmethod
    def _lines(docs: DataFrame) -> DataFrame:
        """(doc, at, no, line, h, g, len) of every line that is not blank; ``h`` has 63 bits."""
        rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("at"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
        lines = rows.withColumn("line", F.btrim("raw", F.lit(_BLANK))).filter("line <> ''")
        return lines.select("doc", "at", "no", "line", F.shiftright(F.xxhash64("line"), 1).alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), F.char_length("line").alias("len"))

    def _links(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b): hashes of distinct lines within the edits allowed."""
        lines = self._once(self._lines(docs).filter(F.col("len") >= self.one_from), classes)
        # Nearly all lists hold one line: what is shuffled of each posting is its key, and its line's hash with the lowest bit for an own segment.
        posted = self._ways(lines).select("key", (F.shiftleft("h", 1) + F.col("own")).alias("mark")).repartition("key")
        h, own, every = F.shiftright("mark", 1), F.col("mark").bitwiseAND(F.lit(1).cast("bigint")), Window.partitionBy("key")
        met = posted.select("key", "mark", F.min(h).over(every).alias("low"), F.max(h).over(every).alias("high"), F.max(own).over(every).alias("owned"))
        met = met.filter("low <> high and owned = 1").groupBy("key", h.alias("h")).agg(F.max(own).alias("own"))
        met = self.scratch.table(met.withColumn("members", F.count("*").over(every)), "met")
        texts = self._texts(docs, met.select("h").distinct())
        short, long_ = met.filter(F.col("members") <= self.long_list), met.filter(F.col("members") > self.long_list)
        near = self._pairs(short).join(_side(texts, "a"), "a").join(_side(texts, "b"), "b").filter(self._close("a", "b")).select("a", "b")
        links = self.scratch.table(near.union(self._linked_in_lists(texts, self._refined(texts, long_))).distinct(), "links")
        self.scratch.drop("met", "texts", "refined", "stars")
        return links

    def _close(self, a: str, b: str) -> Column:
        """Whether two lines are within the edits allowed; lengths and counts of some letters rule out most pairs that are not."""
        one, two = (lambda c: F.col(f"{c}_{a}")), (lambda c: F.col(f"{c}_{b}"))
        allowed = F.when(F.least(one("len"), two("len")) >= self.two_from, 2).otherwise(1)
        letters = reduce(Column.__add__, [F.abs(one("letters")[k] - two("letters")[k]) for k in range(len(_LETTERS) + 1)])
        return (F.abs(one("len") - two("len")) <= allowed) & (letters <= 2 * allowed) & (edits(one("line"), two("line")) <= allowed)

    @staticmethod
    def _once(lines: DataFrame, classes: DataFrame) -> DataFrame:
        """``lines`` without the repeats of those that make up more than a ten-thousandth of all: at most 10,000, so they are broadcast."""
        total = classes.agg(F.sum("times")).first()[0] or 0
        often = classes.filter(F.col("times") * 10_000 > total).filter("times > 1").select(F.col("h").alias("often"), "first")
        kept = lines.join(F.broadcast(often), F.col("h") == F.col("often"), "left")
        again = ~(F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.at") == F.col("at")) & (F.col("first.no") == F.col("no")))
        return kept.filter(F.col("often").isNull() | ~again).select("h", "line", "len")

    def _texts(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(h, line, len, letters) of the wanted lines; their hashes are broadcast where they are few."""
        wanted = self.scratch.table(wanted, "wanted")
        few = wanted.count() <= 1 << 20
        lines = self._lines(docs).filter(F.col("len") >= self.one_from).select("h", "line", "len")
        return self.scratch.table(lines.join(F.broadcast(wanted) if few else wanted, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"), F.min("len").alias("len")).withColumn("letters", letter_counts(F.col("line"))), "texts")

    @staticmethod
    def _pairs(met: DataFrame) -> DataFrame:
        """(a, b): lines that meet in a short list where one of them posted its own segment."""
        x, y = (met.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("h", "own")]) for s in "xy")
        meet = (F.col("own_x") == 1) & (F.col("h_x") != F.col("h_y")) & ((F.col("own_y") == 0) | (F.col("h_x") < F.col("h_y")))
        return x.join(y, "key").filter(meet).select(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")).distinct()

    def _linked_in_lists(self, texts: DataFrame, met: DataFrame) -> DataFrame:
        """(a, b): links within lists of any length, enough of them to connect what is linked.

        First all members are compared with one owner. Those within the edits of it are connected; the other pairs
        are compared in blocks of members, and only links leave a pair of blocks.
        """
        told = met.join(met.groupBy("key").agg(F.min(F.when(F.col("own") == 1, F.col("h"))).alias("pivot")), "key")
        pairs = told.filter("h <> pivot").select(F.col("pivot").alias("a"), F.col("h").alias("b")).distinct()
        stars = self.scratch.table(pairs.join(_side(texts, "a"), "a").join(_side(texts, "b"), "b").filter(self._close("a", "b")).select("a", "b"), "stars")
        told = told.join(stars.select(F.col("a").alias("pivot"), F.col("b").alias("h"), F.col("a").alias("label")), ["pivot", "h"], "left").withColumn("label", F.when(F.col("h") == F.col("pivot"), F.col("h")).otherwise(F.coalesce("label", "h")))
        blocks = F.ceil(F.col("members") / self.block).cast("int")
        placed = told.withColumn("block", F.pmod(F.xxhash64("h"), blocks).cast("int")).join(texts, "h").withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        placed = placed.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
        x, y = (placed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("key", "one", "two", "block", "h", "own", "label", "line", "len", "letters")]) for s in "xy")
        # Of two blocks, or of one with itself, every pair is looked at from the side of each own segment.
        same = reduce(Column.__and__, [F.col(f"{c}_x") == F.col(f"{c}_y") for c in ("key", "one", "two")])
        apart = (F.col("one_x") == F.col("two_x")) | (F.col("block_x") != F.col("block_y"))
        meet = apart & (F.col("own_x") == 1) & (F.col("label_x") != F.col("label_y")) & ((F.col("own_y") == 0) | (F.col("h_x") < F.col("h_y")))
        met = x.join(y, same & meet & self._close("x", "y"))
        return met.select(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")).union(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()

    def _ways(self, lines: DataFrame) -> DataFrame:
        """(key, own, h, and how it was cut): a line's own segments, and substrings that could be a segment of an equally long or shorter line.

        The ways to take a segment are few and the same for all lines, so they are an array literal that is
        exploded; the keys are then plain generated code.
        """
        ways = [
            F.struct(*[F.lit(v).alias(n) for n, v in (("edits", edits), ("less", less), ("rank", rank), ("shift", shift))])
            for edits in (1, 2)
            for less in range(edits + 1)
            for rank in range(edits + 1)
            for shift in range(max(-rank, less - (edits - rank)), min(rank, less + (edits - rank)) + 1)
        ]
        each = lines.select("h", "line", "len", F.explode(F.array(*ways)).alias("w")).select("h", "line", "len", "w.*")
        each = each.withColumn("length", F.col("len") - F.col("less"))
        long_ = F.col("length") >= self.two_from
        each = each.filter(((F.col("edits") == 2) & long_) | ((F.col("edits") == 1) & ~long_ & (F.col("length") >= self.one_from)))
        cut = lambda k: F.floor(F.col("length") * k / (F.col("edits") + 1)).cast("int")
        each = each.withColumn("start", cut(F.col("rank"))).withColumn("width", cut(F.col("rank") + 1) - F.col("start")).withColumn("at", F.col("start") + F.col("shift"))
        each = each.filter((F.col("at") >= 0) & (F.col("at") + F.col("width") <= F.col("len")))
        key = F.xxhash64("length", "rank", F.substring(F.col("line"), F.col("at") + 1, F.col("width")))
        return each.withColumn("key", key).withColumn("own", ((F.col("less") == 0) & (F.col("shift") == 0)).cast("bigint"))

    def _refined(self, texts: DataFrame, met: DataFrame) -> DataFrame:
        """(key, h, own, members): shorter lists in place of the long ones ``met``, that still hold every pair within the edits.

        A segment that is unchanged leaves the edits to the text on its left and on its right. The owner's two
        texts are cut into edits + 1 pieces; a piece without edits lies in the same text of the other line,
        shifted by no more than the edits.
        """
        rows = self._ways(texts.join(met.select("h").distinct(), "h", "left_semi")).join(met.select("key", "h"), ["key", "h"])
        ways = F.array(*[F.struct(F.lit(piece).alias("piece"), F.lit(move).alias("move")) for piece in range(_EDITS + 1) for move in range(-_EDITS, _EDITS + 1)])
        rows = rows.withColumn("w", F.explode(ways)).select("key", "h", "line", "len", "length", "edits", "start", "width", "at", "own", "w.*")
        rows = rows.filter((F.col("piece") <= F.col("edits")) & (F.abs("move") <= F.col("edits")))
        left, right = F.col("start"), F.col("length") - F.col("start") - F.col("width")
        share = F.round((F.col("edits") + 1) * left / (left + right)).cast("int")
        on_left = F.when(left == 0, 0).when(right == 0, F.col("edits") + 1).otherwise(F.greatest(F.lit(1), F.least(F.col("edits"), share)))
        rows = rows.withColumn("on_left", on_left).withColumn("is_left", F.col("piece") < F.col("on_left"))
        n = F.when(F.col("is_left"), F.col("on_left")).otherwise(F.col("edits") + 1 - F.col("on_left"))
        rank = F.when(F.col("is_left"), F.col("piece")).otherwise(F.col("piece") - F.col("on_left"))
        whole = F.when(F.col("is_left"), left).otherwise(right)
        cut = lambda k: F.floor(whole * k / n).cast("int")
        rows = rows.withColumn("from", cut(rank)).withColumn("upto", cut(rank + 1))
        begin = F.when(F.col("is_left"), 0).otherwise(F.col("at") + F.col("width"))
        end = F.when(F.col("is_left"), F.col("at")).otherwise(F.col("len"))
        rows = rows.withColumn("begin", begin + F.col("from") + F.col("move")).withColumn("n", F.col("upto") - F.col("from"))
        rows = rows.filter((F.col("begin") >= begin) & (F.col("begin") + F.col("n") <= end))
        key = F.xxhash64("key", "piece", F.substring(F.col("line"), F.col("begin") + 1, F.col("n")))
        lists = rows.groupBy(key.alias("key"), "h").agg(F.max(F.col("own") * (F.col("move") == 0).cast("bigint")).alias("own"))
        lists = self.scratch.table(lists, "refined")
        members = lists.groupBy("key").agg(F.count("*").alias("members"), F.max("own").alias("owned")).filter("members > 1 and owned = 1")
        return lists.join(members.drop("owned"), "key").select("key", "h", "own", "members")


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, removed_lines, text_md5) of every row."""
    out = LineDedup(spark).run(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "removed_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))
