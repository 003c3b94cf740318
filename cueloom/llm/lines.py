"""Line dedup: lines within a few edits of one another form a class, of which the first line stays.

Two lines may differ by an edit for every SHARE characters of the shorter one, and by RADIUS edits at most; so it is in
proportion for lines of any length, and lines of less than SHARE characters are near only if they are equal.

Method: a segment-partition edit join. A line of a given length is cut into RADIUS + 1 segments. Lines within RADIUS
edits share a segment, so the segments, with number and length of line, are an index, and a line probes it with
those of its substrings that can stand in for a segment of a line as long or up to RADIUS shorter: for each segment
only the few places that leave the rest of the edits to either side. Candidates are verified by a bit-parallel
automaton over the band of 2 * RADIUS + 1 diagonals: three masks, one for each number of edits, moved on by the
characters of the longer line, after what both begin and end with has been passed over by halves. Before that, counts
of letters rule out most candidates: an edit moves them by 2 at most. Those of classes of letters go with the
segments, so that the join itself drops candidates that a common segment brings together; those of all letters follow.

Equal lines become one before anything is compared, by a 64-bit hash, so copies cost nothing; a line is only removed if
a second hash agrees too. A key that many lines have is dealt out: its index in parts of PART lines, each of which
all its probes meet. Only built-in expressions run on the executors. `components` joins links into classes.

Cases: a null or empty text has no lines; blank lines and the white space around lines don't count; rows of equal or
null ids keep their own rows; the first line of a class is that of the smallest id (nulls last), then of the smallest
number; very long lines are lines like any other; other columns of docs are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import SPACES, bind, stored
from cueloom.llm.components import components

RADIUS = 2
#: So many characters of a line allow an edit.
SHARE = 8
#: Lines that one part of a key's index holds.
PART = 4096


def edits(length: Column) -> Column:
    """How many edits a line of this length allows."""
    return F.least(F.floor(length / SHARE).cast("int"), F.lit(RADIUS))


def _lines(text: Column) -> Column:
    """The lines of a text, without white space around them and without blank ones."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda s: F.btrim(s, F.lit(SPACES)))
    return F.filter(trimmed, lambda s: s != "")


def segment(length: Column, i: int, radius: int = RADIUS) -> tuple[Column, Column]:
    """Where the i-th segment (from 0) of a line begins, from 0, and its length; the last length % (radius + 1) have one more."""
    k = radius + 1
    base, longer = F.floor(length / k), length % k
    extra = F.greatest(longer - (k - i), F.lit(0))
    return base * i + extra, base + F.when(longer >= k - i, 1).otherwise(0)


def shifts(i: int, shorter: int, radius: int = RADIUS) -> range:
    """How far from a segment's place its copy can begin in a line that is so much longer."""
    return range(max(-i, shorter - (radius - i)), min(i, shorter + (radius - i)) + 1)


def _key(units: Column, length: Column, i: int, shift: int) -> Column:
    """units: a line in UTF-32, where a character's place is known without looking at those before it."""
    begin, size = segment(length, i)
    return F.xxhash64(F.lit(i), length, F.substring(units, (4 * (begin + shift) + 1).cast("int"), (4 * size).cast("int")))


def within(a: Column, b: Column, radius: int = RADIUS, most: Column | None = None) -> Column:
    """Whether a can be made b in at most radius edits, or most, if it is less; b is the longer one, by radius at most."""
    width = 2 * radius + 1
    full = (1 << width) - 1

    def common(x: Column, y: Column) -> Column:
        """How many of the first characters are passed over: the most of some shares of the shorter line that agree."""
        share = lambda q: F.floor(F.length(x) * q).cast("int")
        cases = F.lit(0)
        for q in (0.25, 0.5, 0.75, 0.875):
            cases = F.when(F.left(x, share(q)) == F.left(y, share(q)), share(q)).otherwise(cases)
        return cases

    def run(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]

        def step(state: Column, c: Column, j: Column) -> Column:
            """State bit d: some prefix of x, d - radius longer than that of y, is within so many edits."""
            same = sum((F.when(F.get(x, j + d - radius) == c, 1 << d).otherwise(0) for d in range(width)), F.lit(0))
            out, before, now = [], None, None
            for e in range(radius + 1):
                old = state[f"e{e}"]
                new = old.bitwiseAND(same)
                if e:
                    new = new.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(now, 1)).bitwiseAND(F.lit(full))
                before, now = old, new
                out.append(new.alias(f"e{e}"))
            return F.struct(*out)

        def ends(s: Column) -> Column:
            out = s[f"e{radius}"]
            for e in range(radius if most is not None else 0):
                out = F.when(most == e, s[f"e{e}"]).otherwise(out)
            return out

        start = F.struct(*[F.lit(sum(1 << (radius + d) for d in range(e + 1))).alias(f"e{e}") for e in range(radius + 1)])
        numbered = F.transform(y, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        end = F.size(x) - F.size(y) + radius
        return F.aggregate(numbered, start, lambda s, t: bind(s, lambda v: step(v, t["c"], t["j"])), lambda s: F.getbit(ends(s), end) == 1)

    cut = bind(F.struct(a.alias("a"), b.alias("b"), common(a, b).alias("k")), lambda p: F.struct(F.substring(p["a"], p["k"] + 1, F.length(p["a"])).alias("a"), F.substring(p["b"], p["k"] + 1, F.length(p["b"])).alias("b")))
    rest = bind(cut, lambda p: bind(F.struct(p["a"].alias("a"), p["b"].alias("b"), common(F.reverse(p["a"]), F.reverse(p["b"])).alias("k")), lambda q: F.struct(F.left(q["a"], F.length(q["a"]) - q["k"]).alias("a"), F.left(q["b"], F.length(q["b"]) - q["k"]).alias("b"))))
    letters = lambda s: F.filter(F.split(s, "", -1), lambda c: c != "")
    return bind(bind(rest, lambda p: F.struct(letters(p["a"]).alias("x"), letters(p["b"]).alias("y"))), run)


#: An edit moves the counts of these classes by 2 at most. A long holds them, four bits each.
CLASSES = (*"eatonirshdl", "ucm", "wfgy", "pbvk", " .,")
LETTERS = "abcdefghijklmnopqrstuvwxyz .,"


def _count(line: Column, letters: str) -> Column:
    return F.length(line) - F.length(F.translate(line, letters, ""))


def _signature(line: Column) -> Column:
    """The counts, modulo 16, of the letters of each class in a long."""
    return sum((F.shiftleft(_count(line, c).bitwiseAND(F.lit(15)).cast("long"), 4 * k) for k, c in enumerate(CLASSES)), F.lit(0).cast("long"))


def _apart(a: Column, b: Column) -> Column:
    """How far the counts of two signatures are apart, at least."""
    total = F.lit(0)
    for k in range(len(CLASSES)):
        d = F.abs(F.shiftright(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * k).bitwiseAND(F.lit(15)))
        total = total + F.least(d, 16 - d)
    return total


#: What a line is asked for: how much shorter the other one is, the segment, and the shift; the plain ones are the index.
PROBES = [(d, i, s) for d in range(RADIUS + 1) for i in range(RADIUS + 1) for s in shifts(i, d)]
PLAIN, EQUAL, SHORTER = 0, 1, 2


def shared_keys(lines: DataFrame) -> DataFrame:
    """id, key, kind and parts of those keys that are in the index and that lines with different hashes have. lines has id (the hash) and line, copies too.

    Keys are worked out before copies are joined, so that no text is shuffled; what a key has in common is an aggregate,
    so nothing grows with the square of those that share it."""
    n = F.length("line")
    units = lines.where(n >= SHARE).select("id", n.alias("n"), F.encode("line", "UTF-32").alias("u"))
    keys = [_key(F.col("u"), F.col("n") - d, i, s).alias(f"k{j}") for j, (d, i, s) in enumerate(PROBES)]
    once = units.select("id", *keys).groupBy("id").agg(*[F.max(f"k{j}").alias(f"k{j}") for j in range(len(PROBES))])
    kinds = F.array(*[F.lit(SHORTER if d else EQUAL if s else PLAIN) for d, _, s in PROBES])
    rows = once.select("id", F.posexplode(F.array(*[f"k{j}" for j in range(len(PROBES))])).alias("at", "key")).select("id", "key", F.get(kinds, F.col("at")).alias("kind")).repartition("key")
    parts = F.ceil(F.count_if(F.col("kind") == PLAIN) / PART).cast("int")
    several = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), parts.alias("parts")).where("low <> high and parts > 0")
    return rows.join(several.select("key", "parts").hint("shuffle_hash"), "key")


def candidates(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """a and b, a < b: hashes of lines that share a key and may be near; once each.

    Lines of one length ask for one another, of which the one with the larger hash is enough."""
    signed = keys.join(texts.select("id", _signature(F.col("line")).alias("letters")), "id")
    index = signed.where(F.col("kind") == PLAIN).select("id", "letters", "key", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    probe = signed.select(F.col("id").alias("other"), F.col("letters").alias("other_letters"), "key", "kind", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = F.when(F.col("kind") == SHORTER, F.col("id") != F.col("other")).otherwise(F.col("id") < F.col("other"))
    found = probe.join(index.hint("shuffle_hash"), ["key", "part"]).where(asked & (_apart(F.col("letters"), F.col("other_letters")) <= 2 * RADIUS))
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def links(lines: DataFrame) -> DataFrame:
    """a and b, hashes of different lines within the edits that they allow, once each; lines has id (the hash) and line, copies too."""
    keys = stored(shared_keys(lines), "line-keys")
    # Only texts of lines that share a key are kept. Copies are joined before the shuffle, so a line that is everywhere
    # doesn't gather; if the ids are known to be few, Spark looks them up before it joins copies.
    once = lines.groupBy("id").agg(F.min("line").alias("line"))
    texts = stored(once.join(keys.select("id").distinct(), "id", "left_semi"), "line-texts")
    pairs = stored(candidates(keys, texts), "line-pairs")
    first, second = (texts.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}")) for k in "ab")
    both = pairs.join(first, "a").join(second, "b")
    ordered = F.when(F.length("line_a") <= F.length("line_b"), F.struct(F.col("line_a").alias("s"), F.col("line_b").alias("l"))).otherwise(F.struct(F.col("line_b").alias("s"), F.col("line_a").alias("l")))
    near = both.select("a", "b", ordered.alias("p")).where(F.length("p.l") - F.length("p.s") <= edits(F.length("p.s")))
    apart = sum((F.abs(_count(F.col("p.s"), c) - _count(F.col("p.l"), c)) for c in LETTERS), F.lit(0))
    near = near.where(apart <= 2 * RADIUS)
    return near.where(within(F.col("p.s"), F.col("p.l"), most=edits(F.length("p.s")))).select("a", "b")


def dedup(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_lines, n_linked (lines with a different one near), n_links (links of its lines),
    n_removed (lines of a class that stands earlier), kept (numbers of the other lines) and classes (a number for each line's class, in order)."""
    number = docs.select("doc_id", F.posexplode(_lines(F.col("text"))).alias("number", "line")).select("doc_id", "number", "line", F.xxhash64("line").alias("id"))
    pairs = stored(links(number.select("id", "line")), "line-links")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    known = stored(ends.join(components(pairs), F.col("id") == F.col("node"), "left").select("id", "links", F.coalesce("root", "id").alias("root")), "line-classes")
    place = lambda: F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("number").alias("k"))
    second = lambda line: F.xxhash64(F.lit("second"), line)
    first = F.struct(place().alias("place"), second(F.col("line")).alias("h"))
    lines = number.select("id", first.alias("first")).groupBy("id").agg(F.min("first").alias("first"), F.count("*").alias("times")).select("id", "first.*", "times")
    rooted = lines.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = rooted.groupBy("root").agg(F.min("place").alias("best"), F.sum("times").alias("times")).where("times > 1")
    # Lines that stand once and have no links need not hear of anything.
    told = stored(rooted.join(best, "root").select("id", "root", F.coalesce("links", F.lit(0)).alias("links"), "best", "h"), "line-places")
    own = docs.select("doc_id", F.transform(_lines(F.col("text")), lambda s: F.struct(F.xxhash64(s).alias("id"), second(s).alias("own_h"))).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    each = own.select("row", "doc_id", F.posexplode_outer("ids").alias("number", "id")).select("row", "doc_id", "number", "id.*").join(told, "id", "left")
    gone = (F.col("h") == F.col("own_h")) & (F.col("best") != place())
    gone = F.coalesce(gone, F.lit(False))
    return each.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count("id").alias("n_lines"), F.count_if(F.col("links") > 0).alias("n_linked"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"), F.count_if(gone).alias("n_removed"),
        F.sort_array(F.collect_list(F.when(F.col("id").isNotNull() & ~gone, F.col("number")))).alias("kept"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("number", F.coalesce("root", "id").alias("root"))))), lambda x: x["root"]).alias("classes"),
    ).drop("row")
