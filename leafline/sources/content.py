"""Sources: driver tables, line operators and content streams."""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

WHITE, DELIMITERS = b"\x00\t\n\f\r ", b"()<>[]{}/%"
TEXT_OPS = ("Tj", "TJ", "'", '"')


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_ops(docs: DataFrame) -> DataFrame:
    """documents as text operators: one a line, numbered from 1."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("op_index"), "text")


def lexemes(stream: bytes):
    """Tokens of a content stream: strings, arrays, names, numbers, operators."""
    i, n = 0, len(stream)
    while i < n:
        c = stream[i : i + 1]
        start = i
        if c in (b"(", b"["):
            depth, inside = 0, False
            closing = {b"(": b")", b"[": b"]"}[c]
            while i < n:
                here = stream[i : i + 1]
                if here == b"\\":
                    i += 1
                elif c == b"[" and here == b"(":
                    inside = True
                elif c == b"[" and here == b")":
                    inside = False
                elif not inside and here == c:
                    depth += 1
                elif not inside and here == closing:
                    depth -= 1
                    if depth == 0:
                        break
                i += 1
            i += 1
        elif c in WHITE:
            i += 1
            continue
        elif c == b"%":
            while i < n and stream[i : i + 1] not in (b"\n", b"\r"):
                i += 1
            continue
        elif stream[i : i + 2] in (b"<<", b">>"):
            i += 2
        elif c == b"<":
            end = stream.find(b">", i)
            i = n if end < 0 else end + 1
        else:
            i += 1
            if c not in b")>]{}":
                while i < n and stream[i : i + 1] not in WHITE and stream[i : i + 1] not in DELIMITERS:
                    i += 1
        yield stream[start:i].decode("latin-1")


def shown_text(token: str) -> str:
    """The text of a literal, hexadecimal or array operand. Escapes of literals are
    undone, octal ones too; a hexadecimal byte that is none counts as a blank."""
    if token.startswith("["):
        return "".join(shown_text(t) for t in lexemes(token[1:-1].encode("latin-1")) if t[0] in "(<")
    if token.startswith("<"):
        digits = "".join(token.strip("<>").split())
        pairs = [digits[i : i + 2].ljust(2, "0") for i in range(0, len(digits), 2)]
        return "".join(chr(int(p, 16)) if all(c in string.hexdigits for c in p) else " " for p in pairs)
    return re.sub(r"\\(?:([0-7]{1,3})|(.))", _escaped, token[1:-1], flags=re.DOTALL)


def _escaped(found: re.Match) -> str:
    octal, other = found.groups()
    if octal:
        return chr(int(octal, 8) % 256)
    return {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": ""}.get(other, other)


@udtf(returnType="op_index int, op string, text string, raw_token string")
class ContentOps:
    """The text-showing operators of one content stream, numbered from 1."""

    def eval(self, stream: bytes):
        held, index = [], 0
        for token in lexemes(bytes(stream or b"")):
            if token in TEXT_OPS:
                index += 1
                operand = held[-1] if held else "()"
                yield index, token, shown_text(operand), operand
                held = []
            elif token[0].isalpha() or token == "*":
                held = []
            else:
                held.append(token)
