"""Fill-in-the-middle: texts are cut into units by Spark's split at zero-width boundaries, and three runs of units change places."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, spare_name

#: Signs of the parts, in the order prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many change form, and of 100 that change, so many put the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20


@dataclass(frozen=True)
class UnitGrammar:
    """Units as runs of character classes, matched from left to right.

    ``classes`` are regex classes of one code point which together hold every code point once (a dot is any), each with whether
    a run of it stays together. ``joined`` lists pairs (i, j): what follows class i in class j belongs to the same unit.
    Classes are lists of ASCII characters or the complement of one, so the halves of a wide code point never tell them apart.
    """

    classes: tuple[tuple[str, bool], ...]
    joined: frozenset[tuple[int, int]] = frozenset()

    def boundary(self) -> str:
        """The zero-width regex of unit boundaries: a lookbehind of one class and a lookahead of the other for each pair of
        neighbours that are not one unit."""
        if any(not one.isascii() or "\\p" in one or "\\P" in one for one, _ in self.classes):
            raise ValueError("classes are lists of ASCII characters or complements of one")
        ends: dict[str, list[str]] = {}
        for i, (left, together) in enumerate(self.classes):
            after = [right for j, (right, _) in enumerate(self.classes) if (i, j) not in self.joined and (i != j or not together)]
            if after:
                ends[left] = after
        return "(?s)" + "|".join(f"(?<={left})(?={'|'.join(after)})" for left, after in ends.items())


#: Every code point is a unit.
CODE_POINTS = UnitGrammar(((".", False),))
#: A word, with the ASCII white space before it.
WORDS = UnitGrammar(((r"[\x20\x09-\x0D]", True), (r"[^\x20\x09-\x0D]", True)), frozenset({(0, 1)}))
#: A line, with its line feed.
LINES = UnitGrammar(((r"[^\n]", True), (r"\n", False)), frozenset({(0, 1)}))


def units(text: Column, grammar: UnitGrammar = CODE_POINTS) -> Column:
    """The units of a text as an array; they are the text when joined. An empty or null text has none, where split gives one
    empty piece."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, grammar.boundary(), -1))


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 that depend on seed and key only: the first digits of a SHA-256, eight by eight."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", grammar: UnitGrammar = CODE_POINTS, seed: int = 1) -> DataFrame:
    """Add n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output.

    Two cuts fall after 0 to n units by the first two draws of the key; the third decides whether the text stays plain, the
    fourth the order. Texts that are empty, null or hold a part sign stay plain. Rows with equal keys and texts (null keys
    too: an empty key) come out equal; all rows and columns stay, input columns with an output's name are replaced. One row is
    held as an array of its units while it is cut, which for code points takes some 100 bytes each; there is no shuffle.
    """
    outs = ("n", "form", "prefix", "middle", "suffix", "output")
    keep = [c for c in df.columns if c.lower() not in outs]
    names = {x: spare_name(df, f"fim_{x}") for x in ("units", "text", "draws", "low", "high", "form")}
    c = {k: F.col(v) for k, v in names.items()}
    d = df.withColumns({names["text"]: F.coalesce(F.col(f"`{text}`"), F.lit("")), names["draws"]: F.array(*draws(F.col(f"`{key}`"), seed))})
    d = d.withColumn(names["units"], units(c["text"], grammar))
    size = F.size(c["units"])
    cut = [F.pmod(c["draws"][k], size + 1).cast("int") for k in range(2)]
    signs = F.contains(c["text"], F.lit(PREFIX)) | F.contains(c["text"], F.lit(SUFFIX)) | F.contains(c["text"], F.lit(MIDDLE))
    form = F.when((size == 0) | signs | (c["draws"][2] % 100 >= FIM_PERCENT), "plain").when(c["draws"][3] % 100 < SPM_PERCENT, "spm").otherwise("psm")
    d = d.withColumns({names["low"]: F.least(*cut), names["high"]: F.greatest(*cut), names["form"]: form})
    part = lambda start, length: F.when(c["form"] != "plain", F.array_join(F.slice(c["units"], start, length), ""))
    d = d.select(
        *[F.col(f"`{x}`") for x in keep], c["text"], size.cast("long").alias("n"), c["form"].alias("form"),
        part(F.lit(1), c["low"]).alias("prefix"), part(c["low"] + 1, c["high"] - c["low"]).alias("middle"), part(c["high"] + 1, size - c["high"]).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return d.withColumn("output", F.when(F.col("form") == "plain", c["text"]).when(F.col("form") == "psm", psm).otherwise(spm)).drop(names["text"])


def restore(output: Column, form: Column) -> Column:
    """The text that an output stands for. No part holds a sign, and a sign cannot arise where parts meet."""

    def joined(parts: Column) -> Column:
        return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))

    return F.when(form == "plain", output).otherwise(let(F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1), joined))


def digests(done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lengths and SHA-256 digests of transformed rows."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return done.select(
        key, "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
