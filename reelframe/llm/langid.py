"""Language by compression: the language whose dictionary makes the text smallest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out, keep_rows, map_rows, split_join, written

#: Documented bounds of the training sample: rows and dictionary bytes of a language, code points of a training text.
ROWS, DICT_BYTES, MAX_CHARS = 600, 112 * 1024, 40_000
#: The same for all languages together: with more of them each has a smaller share, and none is left out.
ALL_ROWS, ALL_BYTES = 60_000, 64 << 20
#: Bytes that are compressed at once.
CHUNK = 4096
#: Share of the size by which the best language must beat the next one; below it the document is rejected.
#: On held-out rows of sf0.1 values from 0.001 to 0.006 reject the same share (dictionaries of a random sample, not of least hashes).
MIN_MARGIN = 0.004

_FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> bytes:
    """The words of the whole text in lower case and order, repeats too: what is said in more chunks weighs more."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "


class Languages:
    """Raw-content dictionaries of each language."""

    def __init__(self, data: dict[str, bytes]):
        self.data = data

    def sizer(self):
        import zstandard as z

        # short matches count: words of a language share syllables more than whole words
        how = z.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=16, strategy=z.STRATEGY_LAZY, write_checksum=0, write_content_size=0, write_dict_id=0
        )
        tools = []
        for name in sorted(self.data):
            d = z.ZstdCompressionDict(self.data[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            tools.append((name, z.ZstdCompressor(dict_data=d, compression_params=how).compress))

        def sizes(text: str) -> list[tuple[int, str]]:
            """(bytes, language), smallest first; ties by name. All of the text is compressed, chunk by chunk."""
            data = fold(text)
            parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
            return sorted((sum([len(f(p)) for p in parts]), name) for name, f in tools)

        return sizes


def training_rows(docs: DataFrame, rows: int = ROWS, max_chars: int = MAX_CHARS, all_rows: int = ALL_ROWS) -> DataFrame:
    """lang, doc_id, text of at most `rows` documents a language, those of least hash of the id, that are not held
    out and have a language and a text with a letter that isn't longer than max_chars.

    Ids alone are ranked, and of a language with many only those of hashes so
    small that about 4 * rows + 400 are left, so that no task ranks more than
    that; that fewer than `rows` are left by it is out of question. A document
    that has several texts counts by the one of least hash.
    """
    known = docs.where(~held_out("doc_id", 4, 2)).where(F.col("lang").isNotNull() & (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", "doc_id", "text")
    ids = written(known.groupBy("lang", "doc_id").agg(F.min(F.xxhash64("text")).alias("h")).withColumn("at", F.xxhash64("doc_id")))
    counts = written(ids.groupBy("lang").agg(F.count("*").alias("n")))
    languages, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = F.least(F.lit(1.0), (4 * rows + 400) / F.col("n"))  # `at` is uniform over 2**64 values
    few = split_join(ids, counts, ["lang"], "n", total).where(F.col("at") <= share * 2.0**64 - 2.0**63)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))
    picked = few.withColumn("rank", rank).where(F.col("rank") <= max(1, min(rows, all_rows // max(1, languages)))).select("lang", "doc_id", "h")
    both = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "doc_id", "h"])
    return both.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def fit_languages(docs: DataFrame, rows: int = ROWS, dict_bytes: int = DICT_BYTES, max_chars: int = MAX_CHARS, all_rows: int = ALL_ROWS, all_bytes: int = ALL_BYTES) -> Languages:
    """Dictionaries of all languages, each of at most dict_bytes from at most `rows` rows; all_rows and all_bytes
    bound what reaches the driver and what it broadcasts, however many documents and languages there are."""
    got = training_rows(docs, rows, max_chars, all_rows).withColumn("at", F.xxhash64("doc_id")).collect()
    names = sorted({r["lang"] for r in got})
    most = {name: max(256, min(dict_bytes, all_bytes // len(names))) for name in names}
    held: dict[str, list[bytes]] = {name: [] for name in names}
    for r in sorted(got, key=lambda r: (r["at"], str(r["doc_id"]))):
        name = r["lang"]
        if most[name] > 0:
            data = fold(r["text"])[: max(2048, most[name])]
            held[name].append(data)
            most[name] -= len(data)
    return Languages({name: b" ".join(x) for name, x in held.items() if x})


def judge(sizes, known: bool, text: str | None) -> tuple[str, float]:
    """(language, margin) of a text."""
    if not (known and text and _LETTER.search(text)):
        return "und", 0.0
    ranked = sizes(text)
    return ranked[0][1], 1.0 if len(ranked) == 1 else 1 - ranked[0][0] / max(1, ranked[1][0])


def detect(docs: DataFrame, model: Languages, key: str = "doc_id", min_margin: float = MIN_MARGIN) -> DataFrame:
    """key, lang_pred, score (0 to 1), margin (share of the size by which the best beats the next) and rejected.

    Null text, or text without a letter: `und`, score 0, rejected. A narrow
    margin sets rejected and leaves the best guess in lang_pred; equal sizes
    are a tie, which goes to the first language by name with a margin of 0.
    With one language learnt its margin is 1; with none all rows are `und`.
    Rows that repeat are judged each, an empty table gives no rows, other
    columns are ignored.
    """
    handed, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[key].dataType.simpleString()

    def task():
        sizes, known = handed.value.sizer(), bool(handed.value.data)

        def each(c):
            out = {key: c[key], "lang_pred": [], "score": [], "margin": [], "rejected": []}
            for t in c["text"]:
                lang, margin = judge(sizes, known, t.as_py())
                out["lang_pred"].append(lang)
                out["margin"].append(margin)
                out["score"].append(0.0 if lang == "und" else min(1.0, 0.5 + 5 * margin))
                out["rejected"].append(lang == "und" or margin < min_margin)
            return out

        return each

    return map_rows(docs, [key, "text"], f"`{key}` {kind}, lang_pred string, score double, margin double, rejected boolean", task)


def keep_known(docs: DataFrame, model: Languages, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs, all columns, that detect() doesn't reject. Null text and text without a letter go, a null
    doc_id is judged by its text, rows that repeat are judged each, and an empty table stays empty."""
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        sizes, known = handed.value.sizer(), bool(handed.value.data)
        return lambda texts: [(j := judge(sizes, known, t.as_py()))[0] != "und" and j[1] >= min_margin for t in texts]

    return keep_rows(docs, "text", task)
