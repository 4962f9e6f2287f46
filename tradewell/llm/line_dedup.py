"""Near-duplicate lines: a segment-partition edit join over the distinct lines of all texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import WHITE, Forest, components, on_blocks, packed, small
from tradewell.sources.io import materialize

MAX_EDITS = 2
#: Shorter lines (in characters, without white space at their ends) are left as they are: list
#: marks, headings and brackets repeat without being copies, and two edits make another word.
MIN_CHARS = 30
#: Rows of a block in which lines that share a segment are compared.
BLOCK_ROWS = 256
#: Place of a line: id of the document, number of the line and a hash of the text as one number.
ORDER = "decimal(38,0)"
NO_ID = 9223372036854775807
ID_UNIT, LINE_UNIT = "10000000000000000000BD", "1000000000BD"


def within_edits(a: str, b: str, limit: int) -> bool:
    """Whether at most ``limit`` insertions, deletions or substitutions turn ``a`` into ``b``.

    What both begin and end with is cut off. Then the differences down a column of the table of
    distances are bits of two numbers, kept for the diagonals at most ``limit`` from the main one
    only; a step of a few bit operations goes to the next column and moves that band down a row.
    The distance is followed along the band's lowest diagonal, then along the last row, and the
    work ends where it can't come down to the limit again.
    """
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b:
        return True
    n = min(len(a), len(b))
    i = _common(a, b, n)
    j = _common(a[::-1], b[::-1], n - i)
    pad = "\0" * (limit + 1)  # the band must not begin below the last row
    a, b = pad + a[i : len(a) - j], pad + b[i : len(b) - j]
    m, n = len(a), len(b)
    width = 2 * limit + 1
    full, low = (1 << width) - 1, 1 << (width - 1)
    plus, minus, distance = (full << limit) & full, 0, limit
    turn = m - limit  # columns after which the band's lowest row is the last row
    most = limit + n - turn
    row = low >> 1
    for col in range(n):
        c, same = b[col], 0
        for r in range(max(0, col - limit), min(m, col + limit + 1)):
            if a[r] == c:
                same |= 1 << (r - col + limit)
        diagonal = ((((same & plus) + plus) ^ plus) | same | minus) & full
        up = minus | (full & ~(diagonal | plus))
        down = diagonal & plus
        if col < turn:
            if not diagonal & low:
                distance += 1
        else:
            distance += bool(up & row) - bool(down & row)
            row >>= 1
            most -= 1
        if distance > most:
            return False
        shifted = diagonal >> 1
        plus = down | (full & ~(shifted | up))
        minus = shifted & up
    return distance <= limit


def _common(a: str, b: str, n: int) -> int:
    """Length of the common beginning of two texts of at least ``n`` characters, ``n`` at most."""
    lo = 0
    while lo < n:
        step = 1
        while lo + step <= n and a[lo : lo + step] == b[lo : lo + step]:
            lo += step
            step *= 2
        if step == 1:
            return lo
    return n


def probes(limit: int) -> list[tuple[int, int, int]]:
    """(d, i, shift): a line of length l looks for segment i of lines of length l - d, ``shift``
    characters from where it starts in such a line; (0, i, 0) are its own segments.

    A line is cut into limit + 1 segments of nearly equal size. If another line is at most
    ``limit`` edits away, at least one segment occurs in it unchanged, and close to its own place:
    segment i starts within i characters of it (i from 0) and, counted from the end, within
    limit - i. So lines are looked for among lines of their own length or up to ``limit`` shorter,
    each with a few substrings.
    """
    found = []
    for d in range(limit + 1):
        for i in range(limit + 1):
            left, right = max(-i, d - (limit - i)), min(i, d + (limit - i))
            found += [(d, i, shift) for shift in range(left, right + 1)]
    return found


def _keyed(lines: DataFrame, limit: int) -> DataFrame:
    """(key, own, h1, h2) for every own and looked-for segment of every line; a key is a hash of
    a length, the number of a segment and its text."""
    n = limit + 1
    listed = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(p, "dis", strict=True)]) for p in probes(limit)])
    rows = lines.select("line", "h1", "h2", F.char_length("line").alias("length"), F.explode(listed).alias("p"))
    rows = rows.select("*", (F.col("length") - F.col("p.d")).alias("size"), "p.i", "p.s")
    base, rest = F.expr(f"cast(size div {n} as int)"), F.col("size") % n
    before = F.greatest(F.lit(0), rest + F.col("i") - n)  # longer segments before this one
    width = base + F.when(rest + F.col("i") > limit, 1).otherwise(0)
    rows = rows.select("*", (base * F.col("i") + before + 1 + F.col("s")).alias("start"), width.alias("width"))
    rows = rows.filter("start >= 1 and start + width - 1 <= length")
    key = F.xxhash64("size", "i", F.substr("line", F.col("start"), F.col("width")))
    return rows.select(key.alias("key"), ((F.col("p.d") == 0) & (F.col("s") == 0)).alias("own"), "h1", "h2")


def _linked(run: pd.DataFrame, limit: int) -> pd.DataFrame | None:
    """Links that connect the lines of a block which edits connect, as few as do that."""
    lines, own, place = run["line"].tolist(), run["own"].tolist(), run["place"].tolist()
    forest, found = Forest(len(lines)), []
    for i in range(len(lines)):
        for j in range(i):
            if (own[i] or own[j]) and abs(len(lines[i]) - len(lines[j])) <= limit:
                if forest.root(i) != forest.root(j) and within_edits(lines[i], lines[j], limit):
                    forest.join(i, j)
                    found.append((place[i], place[j]))
    return pd.DataFrame(found, columns=["a", "b"]) if found else None


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, tag, at, line, h1, h2) of each line of ``docs`` (id, tag, text) that is long enough."""
    lines = docs.select("id", "tag", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(WHITE)))
    lines = lines.filter(F.char_length("line") >= min_chars)
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def _place(id_: str = "id", at: str = "at", tag: str = "tag") -> Column:
    return F.expr(f"cast({id_} as decimal(19,0)) * {ID_UNIT} + {at} * {LINE_UNIT} + {tag}").cast(ORDER)


def line_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    equal_chars: int | None = None,
) -> DataFrame:
    """(id, tag, at, class_id, class_at): for each line that goes, its place and the place of the
    line that stays instead.

    Lines are compared without white space at their ends. Lines are of one class if a chain of
    lines connects them, each at most ``max_edits`` edits from the next; of a class the first
    line stays: that of the least id, then the least line number. ``tag`` tells rows of one id
    apart. A null id comes last, as the greatest long.

    Edits are looked for between lines of ``min_chars`` characters or more. Equal lines are of one
    class from ``equal_chars`` on (``min_chars`` if not given; 1: all lines that are not blank).

    The place of a class's first line is a grouped minimum, so a line that a third of the rows
    hold is one value from the first task on. Only segments held by two different lines lead to
    comparisons; those come in blocks of bounded size. A third step reads the texts of just the
    lines that are compared.
    """
    rows = _keys(docs, id_col, text_col)
    lines = _lines(rows, min_chars if equal_chars is None else max(1, min(min_chars, equal_chars)))
    places = materialize(lines.drop("line"), "lines-places")
    first = places.groupBy("h1", "h2").agg(F.min(_place()).alias("place"))
    first = materialize(first, "lines-first")

    longer = lines.filter(F.char_length("line") >= min_chars)
    keyed = _keyed(longer.select("line", "h1", "h2"), max_edits)
    shared = keyed.groupBy("key").agg(
        F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("own").alias("own")
    )
    shared = materialize(shared.filter("own and lo <> hi").select("key"), "lines-shared")
    members = keyed.join(small(shared), "key").groupBy("key", "h1", "h2").agg(F.max("own").alias("own"))
    members = materialize(members, "lines-members")
    wanted = materialize(members.select("h1", "h2").distinct(), "lines-wanted")
    texts = longer.select("line", "h1", "h2").join(small(wanted), ["h1", "h2"])
    texts = texts.groupBy("h1", "h2").agg(F.min("line").alias("line"))
    texts = materialize(texts.join(first, ["h1", "h2"]), "lines-texts")

    compared = members.join(texts, ["h1", "h2"]).select("key", "own", "place", "line")
    links = on_blocks(
        compared, "key", "place", BLOCK_ROWS, lambda run: _linked(run, max_edits), f"a {ORDER}, b {ORDER}"
    )
    roots = components(links, "a", "b", "lines-links")
    near = materialize(roots.filter("node <> root"), "lines-near")
    final = first.join(near, first["place"] == near["node"], "left")
    final = final.select("h1", "h2", F.coalesce("root", "place").alias("class"))
    gone = places.withColumn("place", _place()).join(final, ["h1", "h2"]).filter("place <> class")
    return gone.select(
        "id",
        "tag",
        "at",
        F.expr(f"class div {ID_UNIT}").cast("long").alias("class_id"),
        F.expr(f"class % {ID_UNIT} div {LINE_UNIT}").cast("int").alias("class_at"),
    )


def _keys(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(
        *more,
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.pmod(F.xxhash64(text), F.lit(10**9)).cast("int").alias("tag"),
        F.coalesce(text, F.lit("")).alias("text"),
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    equal_chars: int | None = None,
) -> DataFrame:
    """One row for each document: ``row``, all its columns; ``text``, without the lines that go;
    ``n_lines``; ``dropped``, the numbers of the lines that go (from 0); ``class_ids``, the ids of
    the documents that hold the lines that stay instead.

    See ``line_classes`` for what goes. Lines of fewer than ``min_chars`` characters stay,
    unless ``equal_chars`` is less: then all but the first of equal ones go. A text of which no
    line stays is empty, a null text empty with one line. Rows of one id and text share their
    lines, so all of them keep the same ones. Line numbers must be below 10 ** 10,
    ids longs (null: last) that are not negative. An empty table gives no rows.
    """
    gone = line_classes(docs, id_col, text_col, max_edits, min_chars, equal_chars).distinct()
    gone = gone.groupBy("id", "tag").agg(
        F.collect_list("at").alias("dropped"), F.array_sort(F.collect_set("class_id")).alias("class_ids")
    )
    gone = materialize(gone, "lines-gone")
    n = gone.agg(F.sum(F.size("dropped") + F.size("class_ids"))).first()[0] or 0
    rows = _keys(docs, id_col, text_col, packed(docs, "row")).join(small(gone, n), ["id", "tag"], "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    # The split text is bound to a name, as a function's body is evaluated for each element.
    stay = F.transform(F.array(lines), lambda xs: F.transform(kept, lambda i: xs[i]))[0]
    none = F.array().cast("array<int>")
    return rows.select(
        "row",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
        F.size(lines).alias("n_lines"),
        F.array_sort(F.coalesce("dropped", none)).alias("dropped"),
        F.coalesce("class_ids", F.array().cast("array<long>")).alias("class_ids"),
    )
