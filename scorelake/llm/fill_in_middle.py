"""Fill-in-middle: whole texts cut at two unit ranks found in an indexable skip list.

A unit is a word with the white space before it; white space at the end is a
unit of its own. A text's skip list has every unit boundary in its lowest lane
and about a quarter of a lane's boundaries in the lane above; each link carries
how many units and how many code points it spans. The two cut ranks come from
the SHA-256 of a seed and the document's id; descending from the top lane by
accumulated unit widths ends exactly on the rank, with its code point.

Only widths leave Python: texts are cut, joined and restored by Spark's own
string functions. Map-only, so no group or key can make a task large.

Cases: null and empty texts are empty and stay plain, and so does a text that
holds a mark; a null id hashes like an empty one; repeated rows are transformed
alike; a text of any length is one list of its units; an empty table gives an
empty result; ``transform`` keeps the columns of ``docs`` and puts its own into
one struct, whose name the caller chooses.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import fresh, ship

# Marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents that could be transformed, and of 100 of those, suffix first.
RATE, SPM_RATE = 50, 80
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(text: np.ndarray) -> np.ndarray:
    """Places after each unit of a text's UTF-8 bytes."""
    if not len(text):
        return np.zeros(0, np.int64)
    space = _SPACE[text]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text))


class SkipList:
    """Unit boundaries by rank. ``lanes[k]`` is (unit widths, code-point widths,
    places in the lane below) of its links; the head is before the first unit."""

    def __init__(self, points: np.ndarray):
        """``points``: code points up to the end of each unit."""
        at = np.concatenate([[0], points])
        # A boundary's height follows from its number, so that a list is the same wherever it is built.
        height = (np.arange(len(at), dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        nodes, below, level = np.arange(len(at)), np.arange(len(at)), 0
        while True:
            self.lanes.append((np.diff(nodes), np.diff(at[nodes]), below))
            level += 1
            higher = height[nodes] < np.uint64(1 << (32 - 2 * level))
            higher[0] = True  # the head is in every lane
            if len(nodes) <= 4 or level == 16 or higher.sum() == len(nodes):
                return
            below = np.flatnonzero(higher)
            nodes = nodes[below]

    def reach(self, rank: int) -> tuple[int, int]:
        """Code points before the unit of this rank, and the links followed."""
        place, units, points, steps = 0, 0, 0, 0
        for unit_widths, point_widths, below in reversed(self.lanes):
            while place < len(unit_widths) and units + unit_widths[place] <= rank:
                units += int(unit_widths[place])
                points += int(point_widths[place])
                place, steps = place + 1, steps + 1
            place = int(below[place])
        if units != rank:
            raise IndexError(rank)
        return points, steps


def cuts(text: Column, first: Column, second: Column, plain: Column) -> Column:
    """``struct<n, prefix, middle>``: units of a text and, unless it is ``plain``,
    code points of its prefix and middle. ``first`` and ``second`` are hashes."""

    @F.pandas_udf("n long, prefix long, middle long")
    def udf(texts: pd.Series, a: pd.Series, b: pd.Series, plain_: pd.Series) -> pd.DataFrame:
        out = []
        for raw, h1, h2, left in zip(texts, a, b, plain_):
            data = np.frombuffer(raw, np.uint8)
            ends = unit_ends(data)
            n = len(ends)
            if left:
                out.append((n, None, None))
                continue
            points = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
            units = SkipList(points)
            low, high = (units.reach(rank)[0] for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
            out.append((n, low, high - low))
        return pd.DataFrame(out, columns=["n", "prefix", "middle"]).astype({"n": "int64", "prefix": "Int64", "middle": "Int64"})

    return udf.asNondeterministic()(text.cast("binary"), first, second, plain)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE, into: str = "fim") -> DataFrame:
    """``docs`` with a struct ``into``: ``n`` units, ``form`` (plain, psm, spm),
    ``prefix_chars`` and ``middle_chars`` (null if plain) and the ``output`` text."""
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (F.length(text) == 0) | marked | (h[2] % 100 >= rate)
    own = F.struct(text.alias("text"), F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm").alias("form"), cuts(text, h[0], h[1], plain).alias("cut"))
    working = fresh(docs, "fim_cut")
    staged = docs.select("*", own.alias(working))
    s = F.col(working)
    whole, low, middle = s["text"], s["cut"]["prefix"].cast("int"), s["cut"]["middle"].cast("int")
    prefix = F.substr(whole, F.lit(1), low)
    inner = F.substr(whole, low + 1, middle)
    rest = F.substr(whole, low + middle + 1)
    mark = F.lit
    output = (F.when(s["form"] == "plain", whole)
              .when(s["form"] == "psm", F.concat(mark(PREFIX), prefix, mark(SUFFIX), rest, mark(MIDDLE), inner))
              .otherwise(F.concat(mark(SUFFIX), rest, mark(PREFIX), prefix, mark(MIDDLE), inner)))
    done = F.struct(s["cut"]["n"].alias("n"), s["form"].alias("form"), s["cut"]["prefix"].alias("prefix_chars"), s["cut"]["middle"].alias("middle_chars"), output.alias("output"))
    return staged.select(*[F.col(c) for c in docs.columns if c.lower() != into.lower()], done.alias(into))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. A transformed text
    holds no mark, so each mark is in its output once."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    head = F.substr(F.split_part(output, first, F.lit(1)), F.lit(1 + len(PREFIX)))
    tail = F.split_part(F.split_part(output, first, F.lit(2)), second, F.lit(1))
    middle = F.split_part(output, second, F.lit(2))
    return (F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail))
            .otherwise(F.concat(tail, middle, head)))


def digests(done: DataFrame, id_col: str = "doc_id", into: str = "fim") -> DataFrame:
    """Counts and digests per document, from the column that ``transform`` adds."""
    s = F.col(into)
    return done.select(
        F.col(id_col).alias("doc_id"), s["n"].alias("n"), s["form"].alias("form"), s["prefix_chars"].alias("prefix_chars"), s["middle_chars"].alias("middle_chars"),
        F.sha2(s["output"], 256).alias("output_sha256"), F.sha2(restored(s["output"], s["form"]), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
