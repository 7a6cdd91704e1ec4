"""Language identification by compression with per-language dictionaries.

Every learned language has a raw-content dictionary of bounded size, made of
slices of its labelled texts. A text is encoded with each dictionary by
zstandard; the language whose dictionary gives the fewest bytes is predicted.
The margin is the share of bytes that it saves against the second best. Where
it is narrow the prediction is rejected: `accepted` is false, and `score`,
margin / (margin + NARROW), is below a half.

Texts are folded first: lower case, every run of what is not a letter one blank.
Long texts are encoded whole, in blocks of bounded size, so that the dictionary
counts as much at the end as at the beginning.

The dictionaries are fitted on a bounded sample: of every language SLICES slices
of SLICE_CHARS characters, each from the labelled text with the smallest hash in
its bucket, of at most LANGUAGES languages, those with most labelled texts. The
sample is one partial aggregation; a language with most rows takes no more room
than others, and copies of a text are in one bucket. Sample and dictionaries are
all that meets the driver, and every task gets the dictionaries (64 x 128 KB at
most). Predictions are made row by row, without a shuffle.

Defined results: a null text, or one without a letter, is `und` with score 0; so
is every text if nothing could be learned. Rows with a null language, and with
texts that have no letter, teach nothing; a row with a null id does. Ties go to
the language with more labelled texts, then to the smaller name, and have margin
0. With one language only, the margin is against encoding without a dictionary.
Repeated rows are predicted alike; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mapped
from plumbline.session import ship

ship(__name__)

#: Bounds of the sample: languages, slices of each, characters of a slice.
LANGUAGES = 64
SLICES = 256
SLICE_CHARS = 512
LEVEL = 6
#: Bytes encoded at a time.
BLOCK = 2048
#: Margins below this are narrow.
NARROW = 0.02
UNKNOWN = "und"

OUT = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


class Folder:
    def __init__(self):
        self.other = re.compile(r"[\W\d_]+")
        self.letter = __import__("regex").compile(r"\p{L}").search

    def fold(self, text: str) -> bytes:
        """Lower-case words, one blank between them."""
        return self.other.sub(" ", text.lower()).strip().encode()


class Encoders:
    """One compressor per language, in the order that ties follow."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = LEVEL):
        import zstandard

        plain = {"level": level, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.names, self.encode = [], []
        for name, content in dictionaries:
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=level)
            self.names.append(name)
            self.encode.append(zstandard.ZstdCompressor(dict_data=made, **plain).compress)
        if len(self.names) == 1:
            self.encode.append(zstandard.ZstdCompressor(**plain).compress)
            self.names.append(self.names[0])

    def sizes(self, folded: bytes) -> list[int]:
        """Bytes of the text under each dictionary."""
        blocks = [folded[i:i + BLOCK] for i in range(0, len(folded), BLOCK)]
        return [sum(len(encode(b)) for b in blocks) for encode in self.encode]

    def predict(self, folded: bytes) -> tuple[str, float]:
        """The language of fewest bytes, and its margin."""
        sizes = self.sizes(folded)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.names[best], (second - sizes[best]) / second


def dictionaries(labelled: DataFrame, languages: int = LANGUAGES, slices: int = SLICES, slice_chars: int = SLICE_CHARS) -> list[tuple[str, bytes]]:
    """Name and content of each language's dictionary, most labelled texts first.

    `labelled`: (text, lang)."""
    sound = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = sound.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    if not counts:
        return []
    known = [r["lang"] for r in counts]
    start = 1 + F.pmod(F.xxhash64("text", F.lit("start")), F.greatest(F.lit(1), F.length("text") - slice_chars + 1)).cast("int")
    drawn = sound.filter(F.col("lang").isin(known)).select(
        "lang", F.pmod(F.xxhash64("text"), F.lit(slices)).alias("bucket"), F.xxhash64("text", F.lit("draw")).alias("draw"),
        F.substring("text", start, F.lit(slice_chars)).alias("slice"))
    # languages x slices rows of bounded texts
    rows = drawn.groupBy("lang", "bucket").agg(F.min(F.struct("draw", "slice")).alias("s")).select("lang", "bucket", "s.slice").collect()
    fold, by = Folder().fold, {name: [] for name in known}
    for r in sorted(rows, key=lambda r: r["bucket"]):
        by[r["lang"]].append(fold(r["slice"]))
    return [(name, b" ".join(parts)) for name, parts in by.items() if any(parts)]


def predicted(docs: DataFrame, learned: list[tuple[str, bytes]], narrow: float = NARROW) -> DataFrame:
    """Rows (doc_id, held_out, text) with their language, score and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, encoders = Folder(), Encoders(learned) if learned else None
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2).to_pylist():
                if encoders is None or text is None or not folder.letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    name, margin = encoders.predict(folder.fold(text))
                    names.append(name)
                    scores.append(max(0.0, margin / (margin + narrow)))
            score = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), score, pa.array([s >= 0.5 for s in scores], pa.bool_())],
                                             names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return mapped(docs, run, OUT)


def identified(docs: DataFrame, narrow: float = NARROW) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    learned = dictionaries(docs.filter(~held_out).select("text", "lang"))
    return predicted(docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text"), learned, narrow)
