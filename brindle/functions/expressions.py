"""Arithmetic expressions as text: + - * / with parentheses and unary minus over 64-bit integers."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(\d+)|(.))")
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3}
LEAST, MOST = -(1 << 63), (1 << 63) - 1


#: Rows from which on an expression's shape is evaluated in columns, and bytes of text that are in columns at a time.
SHARED, SLICE = 8, 1 << 22
#: Digits of numbers that fit in 64 bits whatever they are.
SAFE_DIGITS = 18


def postfix(text: str) -> list[int | str] | None:
    """The numbers and operators of an expression in the order they are worked off; None for malformed text. One pass with a stack, so that neither length nor depth is limited."""
    steps: list[int | str] = []
    pending: list[str] = []
    wants = True  # an operand comes next
    for number, sign in _TOKEN.findall(text.strip()):
        if number:
            if not wants:
                return None
            steps.append(int(number))
            wants = False
        elif sign == "(":
            if not wants:
                return None
            pending.append(sign)
        elif sign == ")":
            if wants:
                return None
            while pending and pending[-1] != "(":
                steps.append(pending.pop())
            if not pending:
                return None
            pending.pop()
        elif sign == "-" and wants:
            pending.append("neg")
        elif sign in _RANK and not wants:
            while pending and pending[-1] != "(" and _RANK[pending[-1]] >= _RANK[sign]:
                steps.append(pending.pop())
            pending.append(sign)
            wants = True
        else:
            return None
    if wants or "(" in pending:
        return None
    return steps + pending[::-1]


def evaluate(text: str | None) -> int | None:
    """The value of an expression; None for null or malformed text, division by 0 and results beyond 64 bits, in between too.

    Operators of a rank bind to the left, division cuts towards zero.
    """
    steps = None if text is None else postfix(text)
    if steps is None:
        return None
    values: list[int] = []
    for op in steps:
        if not isinstance(op, str):
            values.append(op)
            continue
        if op == "neg":
            values.append(-values.pop())
        else:
            b, a = values.pop(), values.pop()
            if op == "/":
                if b == 0:
                    return None
                q = abs(a) // abs(b)
                values.append(q if (a < 0) == (b < 0) else -q)
            else:
                values.append(a + b if op == "+" else a - b if op == "-" else a * b)
        if not LEAST <= values[-1] <= MOST:
            return None
    return values[0] if LEAST <= values[0] <= MOST else None


def _columns(steps: list[int | str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, failed, unsure) of the rows of numbers, each of which takes the places of those in the steps; where unsure, 64 bits can't tell."""
    failed, unsure = np.zeros(len(numbers), bool), np.zeros(len(numbers), bool)
    values: list[np.ndarray] = []
    taken = 0
    with np.errstate(all="ignore"):
        for op in steps:
            if not isinstance(op, str):
                values.append(numbers[:, taken])
                taken += 1
                continue
            b = values.pop()
            if op == "neg":
                failed |= b == LEAST
                values.append(-b)
                continue
            a = values.pop()
            if op == "/":
                failed |= b == 0
                unsure |= (a == LEAST) | (b == LEAST)
                q = np.abs(a) // np.where(b == 0, 1, np.abs(b))
                values.append(np.where((a < 0) == (b < 0), q, -q))
            elif op == "*":
                unsure |= np.abs(a.astype(float) * b.astype(float)) >= 2.0**62
                values.append(a * b)
            else:
                r = a + b if op == "+" else a - b
                failed |= ((a ^ r) & ((b if op == "+" else ~b) ^ r)) < 0
                values.append(r)
    return values[0], failed, unsure


def _evaluate_slice(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, known, left): of the texts that these offsets cut from the data, the values where known, and the rows left to `evaluate`.

    Texts that differ only in their numbers have the same shape, with 0 for each
    number. A shape is read once and worked off over columns of its numbers.
    """
    n = len(offsets) - 1
    values, known, left = np.zeros(n, np.int64), np.zeros(n, bool), np.ones(n, bool)
    digit = (data >= 48) & (data <= 57)
    before = np.concatenate([[False], digit[:-1]])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    begins = digit & ~before
    at = np.flatnonzero(begins)
    size = np.flatnonzero(digit & ~np.concatenate([digit[1:] & before[1:], [False]])) + 1 - at
    number = np.zeros(len(at), np.int64)
    for k in range(min(size.max(initial=0), SAFE_DIGITS)):
        more = size > k
        number = np.where(more, number * 10 + data[np.where(more, at + k, 0)].astype(np.int64) - 48, number)
    long = np.concatenate([[0], np.cumsum(size > SAFE_DIGITS)])
    first = np.searchsorted(at, offsets)
    fits = long[first[1:]] == long[first[:-1]]
    kept = begins | ~digit
    shaped = np.where(digit, np.uint8(48), data)[kept]
    cuts = np.concatenate([[0], np.cumsum(kept)])[offsets]
    shapes = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(shaped)]).dictionary_encode()
    which = shapes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=len(shapes.dictionary)))
    for shape, rows in zip(shapes.dictionary, np.split(order, ends[:-1])):
        if len(rows) < SHARED or not (text := shape.as_py()).isascii():
            continue
        rows = rows[fits[rows]]
        left[rows] = False
        if (steps := postfix(text)) is not None:
            width = sum(not isinstance(x, str) for x in steps)
            values[rows], failed, unsure = _columns(steps, number[first[rows][:, None] + np.arange(width)])
            known[rows] = ~failed & ~unsure
            left[rows] = unsure
    return values, known, np.flatnonzero(left)


def evaluate_all(texts: pa.Array) -> pa.Array:
    """`evaluate` of every text of an Arrow array, in columns for those of a shape that many have."""
    plain = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)
    values, known = np.zeros(len(plain), np.int64), np.zeros(len(plain), bool)
    start = 0
    while start < len(plain):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, "right")) - 1)
        here = slice(start, stop)
        left = np.arange(stop - start)
        if stop - start >= SHARED:
            values[here], known[here], left = _evaluate_slice(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        for row in (left + start).tolist():
            if (found := evaluate(plain[row].as_py())) is not None:
                values[row], known[row] = found, True
        start = stop
    return pa.array(values, mask=~known)


def evaluated(lines: DataFrame, column: str = "value") -> DataFrame:
    """(expression, result) of every row."""
    kind = T.StructType.fromDDL("expression string, result long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            texts = batch.column(0)
            yield pa.RecordBatch.from_arrays([texts.cast(arrow.field(0).type), evaluate_all(texts)], schema=arrow)

    return lines.select(column).mapInArrow(run, kind)


def generated(n: int, seed: int, least: int = -32768, most: int = 32767) -> str:
    """A random expression of n numbers whose value and all parts fit in 64 bits."""
    draw = random.Random(seed)

    def make(k: int) -> tuple[str, int]:
        if k == 1:
            x = draw.randint(least, most)
            return (f"({x})", x) if draw.random() < 0.1 else (str(x), x)
        cut = draw.randint(1, k - 1)
        (a, x), (b, y) = make(cut), make(k - cut)
        fits = {"+": x + y, "-": x - y, "*": x * y} | ({"/": int(abs(x) // abs(y)) * (1 if (x < 0) == (y < 0) else -1)} if y else {})
        op = draw.choice([o for o, v in fits.items() if abs(v) < 1 << 62] or ["+"])
        return f"({a} {op} {b})", fits[op]

    return make(n)[0]


def chunk_counts(texts: DataFrame, column: str = "text", size: int = 4) -> DataFrame:
    """(chunk, n): how often each chunk of `size` characters occurs when lines are cut from their starts, digits read as 0.

    A chunk counts where another character of its line follows, so that the last
    one of a line whose length is a multiple of `size` doesn't.
    """
    plain = F.regexp_replace(F.col(column), "[0-9]", "0")
    return texts.select(F.explode(F.regexp_extract_all(plain, F.lit(f"[^\\n]{{{size}}}(?=[^\\n])"), F.lit(0))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def follows(word: Column) -> Column:
    """The characters that may come after the last one of a word of the expression language, as an array."""
    last = F.right(word, F.lit(1))
    after = {" ": "(*+-/0", "(": "(-0", ")": " )", "-": " 0", "0": " )0"}
    out = F.lit(" ")
    for c, s in after.items():
        out = F.when(last == c, F.lit(s)).otherwise(out)
    return F.split(out, "")


def forbidden() -> list[str]:
    """Sequences that no expression has: binary operators in a row, atoms in a row, an atom alone in parentheses, a binary minus after a parenthesis."""
    twice = [f"{a} {b}" for a in "+-*/" for b in "+*/"] + [f"{a} - " for a in "+-*/"]
    atoms = [f"{a} {b}" for a in "0)" for b in ("0", "(", "-0")]
    alone = [f"({sign}{'0' * k})" for sign in ("", "-") for k in range(1, 6)]
    return ["(- ", *twice, *atoms, *alone]


def legal_words(spark, length: int) -> DataFrame:
    """(word) of all sequences of `length` characters that may be part of an expression, digits written as 0 and at most 5 in a row."""
    words = spark.createDataFrame([(c,) for c in " ()*+-/0"], "word string")
    for _ in range(length - 1):
        longer = words.select(F.explode(F.transform(follows(F.col("word")), lambda c: F.concat("word", c))).alias("word"))
        good = ~F.col("word").endswith("000000")
        for bad in forbidden():
            good = good & ~F.col("word").endswith(bad)
        words = longer.where(good)
    return words
