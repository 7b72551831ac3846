"""Line diffs of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.ordered import attach, hash_salt
from ledgerlens.settings import settle

#: A content of more changes than this is spread over them; the others stay where they are told apart.
POPULAR = 1000


def diff_inputs(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Changes with both contents, or the reason why there is no diff.

    Bytes that are not UTF-8 read as replacement characters.
    """
    salt = hash_salt("session_id", "path")
    sides = F.array_compact(F.array("before_ref", "after_ref"))
    refs = changes.where(F.col("content") == "available").select(F.explode(sides).alias("ref")).distinct()

    def side(c, of):
        # Only referenced blobs move.
        held = blobs.join(of, "ref", "left_semi")
        return held.select(F.col("ref").alias(f"{c}_ref"), F.make_valid_utf8(F.col("content").cast("string")).alias(c))

    # Changes go to the contents, which are dealt out once, and only the first text of a change moves to the second.
    uses = changes.select(F.explode(sides).alias("ref")).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    popular = settle(uses.where(F.col("n") > POPULAR).select("ref"), "popular-refs")
    some = None if popular.isEmpty() else _either(changes, popular)
    plain = changes if some is None else some.where(~F.col("_popular")).drop("_popular")
    both = plain.join(side("after", refs), "after_ref", "left").join(side("before", refs), "before_ref", "left")
    both = both.select(*changes.columns, "before", "after")
    if some is not None:
        # A popular content is spread over its changes.
        rows = some.where("_popular").drop("_popular")
        own = rows.select(F.explode(sides).alias("ref")).distinct().join(refs, "ref", "left_semi")
        spread = attach(attach(rows, side("before", own), ["before_ref"], salt), side("after", own), ["after_ref"], salt)
        both = both.unionByName(spread.select(*changes.columns, "before", "after"))
    gone = lambda c: F.col(f"{c}_ref").isNotNull() & F.col(c).isNull()
    return both.withColumn(
        "reason",
        F.when(F.col("content") != "available",
               F.coalesce("content_note", F.lit("No content was captured for this file.")))
        .when(gone("before"), 'The "before" snapshot is no longer in the blob store.')
        .when(gone("after"), 'The "after" snapshot is no longer in the blob store.'),
    )


def _either(changes: DataFrame, popular: DataFrame) -> DataFrame:
    """Changes, and whether one of their contents is ``_popular``."""
    marked = changes
    for c in ("before", "after"):
        named = popular.select(F.col("ref").alias(f"{c}_ref"), F.lit(True).alias(f"_{c}"))
        marked = marked.join(named, f"{c}_ref", "left")
    either = F.col("_before").isNotNull() | F.col("_after").isNotNull()
    return marked.select(*changes.columns, either.alias("_popular"))


_LINES = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("op", T.StringType()),
    T.StructField("text", T.StringType()),
])


def line_diff(inputs: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Q12: ``session_id, path, line_no, op, text``; op is ' ', '-', '+', or 'note'.

    Pairs are independent, so each is aligned where it lies.  With ``max_lines``, longer
    files come back as one note.
    """
    lines = lambda c: F.coalesce(F.size(F.split(c, "\n")), F.lit(0))
    sized = inputs.withColumn("n", F.greatest(
        F.when(F.col("before").isNotNull(), lines("before")).otherwise(0),
        F.when(F.col("after").isNotNull(), lines("after")).otherwise(0),
    ))
    same = F.col("before").eqNullSafe(F.col("after"))
    note = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when((F.col("n") > max_lines) if max_lines is not None else F.lit(False), F.concat(
            F.lit("This file is "), F.col("n").cast("string"), F.lit(" lines — too large to diff.")))
        .when(same, "The content is identical between the two snapshots.")
    )
    # Notes pass with the pairs, so that the contents are joined once.
    open_ = lambda c: F.when(F.col("note").isNull(), F.col(c)).alias(c)
    todo = sized.withColumn("note", note).select("session_id", "path", open_("before"), open_("after"), "note")
    return todo.mapInArrow(_align_batches, _LINES)


#: Lines that leave a task together.
OUT_LINES = 65_536


def _align_batches(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        owners = batch.select(["session_id", "path"])
        places, counts, ops, texts = [], [], [], []

        def flush():
            at = pa.array(np.repeat(places, counts).astype(np.int64))
            number = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
            columns = [*(c.take(at) for c in owners.columns), pa.array(number), pa.array(ops, pa.string()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, [f.name for f in _LINES.fields])

        noted = batch.column("note").to_pylist() if "note" in batch.schema.names else [None] * batch.num_rows
        for place, (before, after, note) in enumerate(zip(batch.column("before"), batch.column("after"), noted)):
            script = _align(before.as_py(), after.as_py()) if note is None else [("note", note)]
            if script:
                places.append(place)
                counts.append(len(script))
                ops += [op for op, _ in script]
                texts += [text for _, text in script]
            if len(ops) >= OUT_LINES:
                yield flush()
                places, counts, ops, texts = [], [], [], []
        if ops:
            yield flush()


#: Boxes of fewer cells are halved at once; larger ones are searched by number of edits first.
SMALL_BOX = 1_000_000
#: Levels of line blocks (1, 2, 4, … lines) that are compared as wholes.
LEVELS = 11


def _align(before: str | None, after: str | None) -> list[tuple[str, str]]:
    """A shortest edit script, in space linear in the number of lines.

    A box of lines against lines is cut at a point that a shortest script passes, until one
    side is empty.  In a large box that point is looked for from both corners, edit by edit,
    so that few edits in long texts cost little; where there are many, and in small boxes, half
    of the first text is matched against every split of the second.  Texts without a common line
    need no search.
    """
    import numpy as np

    a = [] if before is None else before.split("\n")
    b = [] if after is None else after.split("\n")
    if set(a).isdisjoint(b):
        return [("-", t) for t in a] + [("+", t) for t in b]
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(t, len(codes)) for t in a], dtype=np.int64)
    y = np.array([codes.setdefault(t, len(codes)) for t in b], dtype=np.int64)
    blocks = None
    out: list[tuple[str, str]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, left, right = todo.pop()
        same = _shared(x[low:high], y[left:right])
        out += [(" ", t) for t in a[low:low + same]]
        low, left = low + same, left + same
        if low == high or left == right:
            out += [("-", t) for t in a[low:high]] + [("+", t) for t in b[left:right]]
            continue
        same = _shared(x[low:high][::-1], y[left:right][::-1])
        if same:
            todo += [(high - same, high, right - same, right), (low, high - same, left, right - same)]
            continue
        if high - low == 1:
            # The first common line is the cut; before it all is new.
            at = np.flatnonzero(y[left:right] == x[low])
            if len(at):
                cut = left + int(at[0])
                out += [("+", t) for t in b[left:cut]] + [(" ", a[low])] + [("+", t) for t in b[cut + 1:right]]
            else:
                out += [("-", a[low])] + [("+", t) for t in b[left:right]]
            continue
        point = None
        if (high - low) * (right - left) > SMALL_BOX:
            blocks = blocks or _Blocks(x, y)
            point = blocks.meeting(low, high, left, right)
        if point is None:
            middle = (low + high) // 2
            common = _common(x[low:middle], y[left:right]) + _common(x[middle:high][::-1], y[left:right][::-1])[::-1]
            point = middle, left + int(np.argmax(common))
        todo += [(point[0], high, point[1], right), (low, point[0], left, point[1])]
    return out


def _shared(x, y) -> int:
    """How many lines two texts begin with alike."""
    import numpy as np

    n, told, size = min(len(x), len(y)), 0, 16
    while told < n:
        differ = np.flatnonzero(x[told:told + size][:n - told] != y[told:told + size][:n - told])
        if len(differ):
            return told + int(differ[0])
        told, size = min(told + size, n), size * 4
    return n


class _Blocks:
    """Numbers of equal blocks of 1, 2, 4, … lines of both texts, to compare long stretches quickly."""

    def __init__(self, x, y) -> None:
        import numpy as np

        n, m = len(x), len(y)
        self.shift = n + 1
        line = np.full(n + 1 + m, -1, np.int64)
        line[:n], line[n + 1:] = x, y
        self.of = [np.unique(line, return_inverse=True)[1].astype(np.int32)]
        for level in range(1, LEVELS):
            half = 1 << (level - 1)
            held = self.of[-1].astype(np.int64)
            if len(held) <= 2 * half:
                break
            pair = held[:-half] * (int(held.max()) + 1) + held[half:]
            number = np.full(len(held), -1, np.int32)
            number[:-half] = np.unique(pair, return_inverse=True)[1]
            self.of.append(number)

    def ahead(self, i, j, high: int, right: int, back: bool):
        """How many lines agree from ``i`` and ``j`` on, or before them, inside the box that ends (begins) there."""
        import numpy as np

        told = np.zeros(len(i), np.int64)
        room = np.minimum(i - high, j - right) if back else np.minimum(high - i, right - j)
        top = len(self.of) - 1
        going = np.flatnonzero(room > 0)
        while len(going):
            # Whole blocks of the largest size first; who cannot go on with them ends with smaller ones.
            at = -told[going] - (1 << top) if back else told[going]
            fits = told[going] + (1 << top) <= room[going]
            p, q = i[going] + at, self.shift + j[going] + at
            p, q = np.where(fits, p, 0), np.where(fits, q, 0)
            more = fits & (self.of[top][p] == self.of[top][q])
            told[going[more]] += 1 << top
            going = going[more]
        for level in range(top - 1, -1, -1):
            size = 1 << level
            fits = told + size <= room
            at = -told - size if back else told
            p, q = np.where(fits, i + at, 0), np.where(fits, self.shift + j + at, 0)
            told += np.where(fits & (self.of[level][p] == self.of[level][q]), size, 0)
        return told

    def meeting(self, low: int, high: int, left: int, right: int) -> tuple[int, int] | None:
        """Where the furthest ways from both corners meet with the fewest edits; None if halving is cheaper."""
        import numpy as np

        n, m = high - low, right - left
        delta, none = n - m, -(1 << 40)
        most = int((n * (12 + 0.003 * m)) ** 0.5)
        width = most + 2
        ways = [np.full(2 * width + 1, none, np.int64), np.full(2 * width + 1, none, np.int64)]
        for edits in range(most):
            for back in (False, True):
                mine, other = ways[back], ways[not back]
                k = np.arange(-edits + 2 * max(0, edits - m), edits - 2 * max(0, edits - n) + 1, 2)
                if edits:
                    far = np.maximum(mine[width + k - 1] + 1, mine[width + k + 1])
                else:
                    far = np.zeros(1, np.int64)
                good = (far >= 0) & (far <= n) & (far - k <= m) & (far - k >= 0)
                k, far = k[good], far[good]
                if back:
                    far = far + self.ahead(high - far, right - far + k, low, left, True)
                else:
                    far = far + self.ahead(low + far, left + far - k, high, right, False)
                mine[width + np.arange(-edits, edits + 1, 2)] = none
                mine[width + k] = far
                if (delta % 2 == 1) == (not back):
                    across = delta - k
                    near = np.abs(across) <= edits
                    met = np.flatnonzero(near & (far + other[width + np.where(near, across, 0)] >= n))
                    if len(met):
                        at = int(met[0])
                        p, q = int(far[at]), int(far[at] - k[at])
                        return (high - p, right - q) if back else (low + p, left + q)
        return None


def _common(x, y):
    """For every beginning of ``y``, how many lines it shares, in order, with all of ``x``."""
    import numpy as np

    row = np.zeros(len(y) + 1, dtype=np.int32)
    for code in x:
        row[1:] = np.maximum.accumulate(np.where(y == code, row[:-1] + 1, row[1:]))
    return row
