"""Problem 9: one consistent form for text that looks the same but is written with different characters.

1. Characters of ASCII stand for themselves under every rule below. What a text has besides, each run of other
   characters with the ASCII character before it, which a mark may follow, is a stretch; a run of more than
   STRETCH_MOST characters is cut before its next letter. No rule reaches over the ends of a stretch.
2. Every different stretch of the table is exploded once to positioned code points.
3. A broadcast join replaces each code point: compatibility decomposition, look-alike letters, kinds of space and of
   hyphen, nothing for what cannot be seen. The table follows from Unicode's data by rule, its size is checked.
4. A letter and the marks behind it form a segment; the marks are put in order of their combining class.
5. A second broadcast join composes whole segments; what is not in its table is composed mark by mark. Segments are put
   together again in order of their positions.
6. Texts are exploded to positioned stretches, joined with their forms and put together with the ASCII between.

What a task holds follows from counts, not from bytes of files: POINTS code points, STRETCHES stretches of texts.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import Workspace

#: Letters of other scripts that look like a Latin letter, and that letter.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ԍ": "g", "ѵ": "v",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "Ӏ": "I", "Ѵ": "V",
    # Greek, small
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "κ": "k", "ϲ": "c", "ϳ": "j",
    # Greek, capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    # Coptic and Lisu, capital
    "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲭ": "X", "Ⲕ": "K", "Ⲙ": "M", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G",
    "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V",
    "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin letters drawn like a plain one
    "ɡ": "g", "ɑ": "a",
}
#: Hyphens; dashes are longer and differ to a reader.
HYPHENS = "‐‑⁃﹣－"
#: Characters without an outline that Unicode does not file under formats or controls.
BLANKS = "͏ᅟᅠ឴឵ㅤﾠ"

#: Code points behind which a stretch is cut, before the next letter; modifiers and Hangul, whose parts join, do not count.
STRETCH_MOST = 32
STRETCH = r"[\x20-\x7e\n\t]?+[^\x20-\x7e\n\t](?:[^\x20-\x7e\n\t]{%d}[[^\x20-\x7e\n\t\p{Lu}\p{Ll}\p{Lo}]\p{IsHangul}]*|[^\x20-\x7e\n\t]*)" % (STRETCH_MOST - 1)
#: Texts without a character that any rule could touch.
PLAIN = r"\A[\x20-\x7e\n\t]*\z"
POINTS, STRETCHES = 100_000, 200_000  # code points, stretches of texts a partition
FORMS_LIMIT = 8 << 20  # bytes of stretches and their forms up to which they are broadcast
VOWELS, TAILS = (0x1161, 0x1175), (0x11A8, 0x11C2)  # conjoining jamo that continue a syllable
TABLE_LIMIT = 64 << 20  # bytes a broadcast table may take; both take less than 2 MB


def confusables(path: str) -> dict[str, str]:
    """A mapping from a public file of confusables: lines of `code point ; code points ; kind`, # starts a comment.

    Of each entry whose source is one code point and whose target is one Latin letter the target is taken.
    """
    out: dict[str, str] = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            fields = [x.strip() for x in line.split("#")[0].split(";")]
            if len(fields) >= 2 and fields[0] and " " not in fields[0] and " " not in fields[1]:
                source, target = chr(int(fields[0], 16)), chr(int(fields[1], 16))
                if unicodedata.name(target, "").startswith("LATIN") and source > "\x7f":
                    out[source] = target
    return out


def replacement(cp: int, letters: dict[str, str] = LOOKALIKES) -> str:
    """What a code point stands for: nothing if it cannot be seen, else decomposed and mapped code points.

    Precomposed Hangul syllables stay whole; jamo are composed to them.
    """
    ch = chr(cp)
    if ch in "\n\t":
        return ch
    if ch in "\r  \u0085\x0b\x0c":
        return "\n"
    if 0xAC00 <= cp <= 0xD7A3:
        return ch
    out = ""
    for c in unicodedata.normalize("NFKD", ch):
        kind = unicodedata.category(c)
        if kind in ("Cf", "Cc", "Cs") or c in BLANKS or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
            continue
        out += " " if kind == "Zs" else "-" if c in HYPHENS else letters.get(c, c)
    return out


@cache
def _replacements(letters: tuple[tuple[str, str], ...]) -> pa.Table:
    """(cp, parts array<struct<c, k>>) of all code points that change or are marks; k: combining class, 1000 and
    1001 for jamo that continue a syllable."""
    by, rows = dict(letters), []
    kind = lambda c: 1000 if VOWELS[0] <= ord(c) <= VOWELS[1] else 1001 if TAILS[0] <= ord(c) <= TAILS[1] else unicodedata.combining(c)
    for cp in (*range(0x7F), *range(0x7F, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)):
        out = replacement(cp, by)
        if out != chr(cp) or kind(chr(cp)):
            rows.append({"cp": chr(cp), "parts": [{"c": c, "k": kind(c)} for c in out]})
    return pa.Table.from_pylist(rows, schema=pa.schema([("cp", pa.string()), ("parts", pa.list_(pa.struct([("c", pa.string()), ("k", pa.int32())])))]))


@cache
def _compositions() -> tuple[pa.Table, dict[str, str]]:
    """((segment, composed) of every composed code point, {letter and mark: composed}): what may be written as one."""
    rows, pairs = [], {}
    for cp in (*range(0xC0, 0xAC00), *range(0xF900, 0x30000)):
        d = unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and " " in d:
            whole = unicodedata.normalize("NFD", chr(cp))
            if unicodedata.normalize("NFC", whole) == chr(cp):
                rows.append({"segment": whole, "composed": chr(cp)})
                a, b = (chr(int(x, 16)) for x in d.split())
                pairs[a + b] = chr(cp)
    for cp in range(0xAC00, 0xD7A4):
        rows.append({"segment": unicodedata.normalize("NFD", chr(cp)), "composed": chr(cp)})
        if (cp - 0xAC00) % 28:
            rows.append({"segment": chr(cp - (cp - 0xAC00) % 28) + chr(0x11A7 + (cp - 0xAC00) % 28), "composed": chr(cp)})
    return pa.Table.from_pylist(rows, schema=pa.schema([("segment", pa.string()), ("composed", pa.string())])), pairs


def _broadcast(spark: SparkSession, t: pa.Table) -> DataFrame:
    if t.nbytes > TABLE_LIMIT:
        raise ValueError(f"a mapping of {t.nbytes} bytes is too large to be broadcast")
    return F.broadcast(spark.createDataFrame(t))


def _stepwise(parts: Column) -> Column:
    """parts: array<struct<k, at, j, c>>, a letter and its marks in order, composed mark by mark.

    A mark joins the letter if the pair has a composed form and no mark of its class or a higher one stands between.
    """
    pairs = F.create_map(*[F.lit(x) for kv in sorted(_compositions()[1].items()) for x in kv])
    start = F.struct(F.get(parts, F.lit(0))["c"].alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def add(s: Column, m: Column) -> Column:
        whole = F.when(s["last"] < m["k"], F.try_element_at(pairs, F.concat(s["letter"], m["c"])))
        return F.struct(
            F.coalesce(whole, s["letter"]).alias("letter"),
            F.when(whole.isNull(), F.concat(s["rest"], m["c"])).otherwise(s["rest"]).alias("rest"),
            F.when(whole.isNull(), m["k"]).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(F.slice(parts, 2, F.size(parts)), start, add, lambda s: F.concat(s["letter"], s["rest"]))


def _stretch_forms(stretches: DataFrame, points: int, letters: dict[str, str]) -> DataFrame:
    """(piece, s): the consistent form of each stretch. stretches: (piece), no piece twice; points: their code points."""
    spark = stretches.sparkSession
    odd = stretches.select("piece", F.struct(F.xxhash64("piece").alias("h"), F.monotonically_increasing_id().alias("n")).alias("id")).repartition(1 + points // POINTS, "id")
    out_of_sight = _broadcast(spark, _replacements(tuple(sorted(letters.items()))))
    lone = F.array(F.struct(F.col("cp").alias("c"), F.lit(0).alias("k")))
    pieces = odd.select("id", F.posexplode(F.regexp_extract_all("piece", F.lit("(?s)."), F.lit(0))).alias("at", "cp"))
    points = pieces.join(out_of_sight, "cp", "left").select("id", "at", F.posexplode(F.coalesce("parts", lone)).alias("j", "p")).select("id", "at", "j", "p.c", "p.k")
    in_order = W.partitionBy("id").orderBy("at", "j")
    before, last = F.lag("k").over(in_order), F.lag("c").over(in_order)
    joins_on = ((F.col("k") == 1000) & last.between("ᄀ", "ᄒ")) | ((F.col("k") == 1001) & ((before == 1000) | last.between("가", "힣")))
    # no composed form has jamo and a mark, so marks behind jamo are a segment of their own
    starts = F.when(F.col("k") >= 1000, ~F.coalesce(joins_on, F.lit(False))).when(F.col("k") == 0, True).otherwise(F.coalesce(before >= 1000, F.lit(False)))
    points = points.select("id", "at", "j", "c", "k", starts.alias("starts"))
    points = points.withColumn("seg", F.sum(F.col("starts").cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # inside a segment: the letter, jamo that continue it, then the marks by class; equal classes keep their order
    rank = F.when(F.col("starts") & ((F.col("k") == 0) | (F.col("k") >= 1000)), -1).when(F.col("k") >= 1000, 0).otherwise(F.col("k")).cast("int")
    segments = points.groupBy("id", "seg").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "at", "j", "c"))).alias("parts"))
    segments = segments.withColumn("segment", F.array_join(F.transform("parts", lambda p: p["c"]), ""))
    composed = segments.join(_broadcast(spark, _compositions()[0]), "segment", "left")
    alone = (F.size("parts") == 1) | (F.get("parts", F.lit(0))["k"] >= 0)
    composed = composed.select("id", "seg", F.coalesce("composed", F.when(alone, F.col("segment")).otherwise(_stepwise(F.col("parts")))).alias("s"))
    forms = composed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "s"))), lambda p: p["s"]), "").alias("form"))
    return odd.join(forms, "id", "left").select("piece", F.coalesce("form", F.lit("")).alias("s"))


def unify(df: DataFrame, key: str, text: str = "text", letters: dict[str, str] | None = None) -> DataFrame:
    """(key, text, form): the text's consistent form, one row for each row of df with a text.

    Rows with a null text are left out; an empty text and one with nothing visible have an empty or blank form.
    Letter case, visible accents, punctuation, line breaks and the number of spaces are kept. letters: the look-alike
    letters, by default LOOKALIKES; confusables() reads a larger mapping from a public file.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "stretches")
    letters = LOOKALIKES if letters is None else letters
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    plain = rows.where(F.col("__text").rlike(PLAIN)).select("__key", "__text", F.col("__text").alias("form"))
    odd = rows.where(~F.col("__text").rlike(PLAIN)).withColumn("id", F.struct(F.xxhash64("__key", "__text").alias("h"), F.monotonically_increasing_id().alias("n")))
    one_break = F.replace("__text", F.lit("\r\n"), F.lit("\n"))  # a line break of two characters is one
    cut = F.regexp_extract_all(one_break, F.lit(STRETCH), F.lit(0))
    stretches = ws.save(odd.select(F.explode(cut).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "stretches")
    in_all, points = stretches.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.char_length("piece")), F.lit(0))).first()
    made = ws.save(_stretch_forms(stretches.select("piece"), points, letters), "forms")
    size = made.agg(F.coalesce(F.sum(F.octet_length("piece") + F.octet_length("s")), F.lit(0))).first()[0]
    odd = odd.repartition(max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism, 1 + in_all // STRETCHES), "id")
    found = odd.select("id", F.posexplode(cut).alias("at", "piece")).join(F.broadcast(made) if size <= FORMS_LIMIT else made, "piece")
    found = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "s")))["s"].alias("found"))
    between = F.split(one_break, STRETCH, -1)
    form = F.array_join(F.zip_with(between, F.coalesce("found", F.array().cast("array<string>")), lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")
    whole = odd.join(found, "id", "left").select("__key", "__text", form.alias("form"))
    return plain.unionByName(whole).withColumnsRenamed({"__key": key, "__text": text})


def _hashed(df: DataFrame, key: str, text: str, letters: dict[str, str] | None) -> DataFrame:
    # forms without anything visible are left out when this is read: a filter before would make each form twice
    f = unify(df, key, text, letters).select(F.col("form").rlike(r"\S").alias("seen"), F.col(key).alias("doc"), F.xxhash64("form").alias("f1"), F.xxhash64("form", F.lit(1)).alias("f2"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"))
    return Workspace(df.sparkSession, "forms").save(f, "hashes").where("seen").drop("seen")  # read several times, made once


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", letters: dict[str, str] | None = None) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents whose texts differ but have one consistent form.

    Texts are compared by two 64-bit hashes of form and text; identical texts, null texts and texts with nothing
    visible are no pair. A key that comes again with the same text counts once.
    """
    return _pairs(_hashed(df, key, text, letters))


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text", letters: dict[str, str] | None = None) -> DataFrame:
    """(doc, class_doc, text_doc, n_texts): a row for each document whose form is that of another text as well.

    class_doc: the least document of the form, text_doc: the least one with the very same text, n_texts: how many
    different texts share the form. This holds all that the pairs hold, without writing them out.
    """
    docs = _hashed(df, key, text, letters)
    texts = docs.groupBy("f1", "f2", "t1", "t2").agg(F.min("doc").alias("text_doc"))
    forms = texts.groupBy("f1", "f2").agg(F.min("text_doc").alias("class_doc"), F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    j = docs.join(texts, ["f1", "f2", "t1", "t2"]).join(forms, ["f1", "f2"])
    return j.select("doc", "class_doc", "text_doc", "n_texts").distinct()


def _pairs(docs: DataFrame) -> DataFrame:
    """docs(f1, f2, t1, t2, doc). Texts of one form are paired first, copies are expanded only for such a pair."""
    texts = docs.groupBy("f1", "f2", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    a = texts.select("f1", "f2", F.col("t1").alias("a1"), F.col("t2").alias("a2"))
    b = texts.select("f1", "f2", F.col("t1").alias("b1"), F.col("t2").alias("b2"))
    pairs = a.join(b, ["f1", "f2"]).where((F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2"))))
    side = lambda c, name: docs.select("f1", "f2", F.col("t1").alias(f"{c}1"), F.col("t2").alias(f"{c}2"), F.col("doc").alias(name))
    j = pairs.join(side("a", "x"), ["f1", "f2", "a1", "a2"]).join(side("b", "y"), ["f1", "f2", "b1", "b2"])
    return j.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
