"""Language identification by a string kernel.

Blended-spectrum presence kernel: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), G being a text's set of character n-grams
of lengths 1 to 3. Nystroem landmarks map a text to its kernel values with a few training texts, whitened; one-versus-rest
ridge regression on that map gives a score per language. Scoring is two matrix products per block of texts.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.llm.common import chunks, map_arrow, without

#: An n-gram is a number: 21 bits for each of its symbols. Symbols are code points plus one for letters and the marks that belong to
#: them, and 1 for anything else, so no symbol is 0 and lengths are told apart.
BITS, OTHER = 21, 1


@dataclass
class Model:
    """columns: sorted n-grams of the landmarks; landmarks: presence, columns x texts; sizes: |G| of each landmark; weights:
    landmarks x languages, Nystroem whitening included."""

    columns: object
    landmarks: object
    sizes: object
    weights: object
    languages: list[str]


def _is_letter(point: int) -> bool:
    return chr(point).isalpha() or unicodedata.category(chr(point))[0] == "M"


class Presence:
    """Texts -> (presence over the given n-grams, |G|), a block at a time."""

    def __init__(self, columns) -> None:
        import numpy as np

        self.columns = columns
        letter = np.fromiter(map(_is_letter, range(1 << 16)), bool, 1 << 16)
        self.table = np.where(letter, np.arange(1 << 16) + 1, OTHER).astype("i8")

    def codes(self, text: str):
        import numpy as np

        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        out = self.table[np.minimum(points, 0xFFFF)]
        far = np.flatnonzero(points > 0xFFFF)
        if len(far):
            out[far] = [p + 1 if _is_letter(p) else OTHER for p in points[far].tolist()]
        return out

    def grams(self, text: str):
        """Sorted distinct n-grams of the whole text. Runs of other symbols count as one, and texts are taken as if between two of
        them. Shorter n-grams are the beginnings of longer ones, so only the longest are sorted at full length."""
        import numpy as np

        c = np.concatenate(([OTHER], self.codes(text), [OTHER]))
        c = c[np.concatenate(([True], (c[1:] != OTHER) | (c[:-1] != OTHER)))]
        three = np.unique(c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])
        two = np.unique(np.append(three >> BITS, c[-2:-1] << BITS | c[-1:]))
        return np.concatenate((np.unique(np.append(two >> BITS, c[-1])), two, three))

    def block(self, texts: list[str]):
        import numpy as np

        out, sizes = np.zeros((len(texts), len(self.columns)), "f4"), np.zeros(len(texts))
        for i, t in enumerate(texts):
            g = self.grams(t)
            sizes[i] = len(g)
            at = np.minimum(np.searchsorted(self.columns, g), len(self.columns) - 1)
            out[i, at[self.columns[at] == g]] = 1
        return out, sizes


def train(rows: list[tuple[str, str]], landmarks_per_language: int = 24, ridge: float = 1e-2, most_entries: int = 1 << 25) -> Model | None:
    """rows: (lang, text). The first landmarks_per_language texts of each language are its landmarks, or fewer (one at least) where
    n-grams times landmarks would pass most_entries; all rows train."""
    import numpy as np

    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    maker, columns, chosen = Presence(None), np.zeros(0, "i8"), []
    for k in range(landmarks_per_language):  # a further text of every language, as long as the table of landmarks stays small
        more = [t for lang in languages for t in [t for x, t in rows if x == lang][k : k + 1]]
        wider = np.unique(np.concatenate([columns, *map(maker.grams, more)]))
        if not more or chosen and len(wider) * (len(chosen) + len(more)) > most_entries:
            break
        columns, chosen = wider, chosen + more
    maker.columns = columns
    land, land_sizes = maker.block(chosen)
    kernel = lambda p, n: (p @ land.T) / np.sqrt(np.maximum(n, 1)[:, None] * land_sizes)
    values, vectors = np.linalg.eigh(kernel(land, land_sizes).astype("f8"))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi, y = [], []
    for a in range(0, len(rows), 256):
        p, n = maker.block([t for _, t in rows[a : a + 256]])
        phi.append(kernel(p, n) @ whiten)
        y += [languages.index(lang) for lang, _ in rows[a : a + 256]]
    phi, y = np.concatenate(phi), np.array(y)
    # classes weigh alike, however many rows each has
    weight = (1 / np.bincount(y, minlength=len(languages)))[y] * len(y) / len(languages)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, 0.0)
    gram = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
    beta = np.linalg.solve(gram, (phi * weight[:, None]).T @ target)
    return Model(columns, land.T.copy(), land_sizes, whiten @ beta, languages)


def sample(docs: DataFrame, per_language: int, longest: int, most_languages: int) -> list[tuple[str, str]]:
    """(lang, text) of at most per_language rows of each of the most_languages most frequent languages: those of the smallest hash
    of doc_id with a letter, a longer text by a piece of `longest` characters from a keyed place. Two scans: languages are counted without the texts,
    then a fraction that should hold twice the rows asked for is read; only those rows are ranked, so what is collected has a bound."""
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    key = F.xxhash64(F.col("doc_id"), F.lit("langid"))
    share = F.least(F.lit(1.0), (4 * per_language + 200) / F.col("count"))
    parts = F.broadcast(counts.select("lang", (share * float(1 << 62)).cast("long").alias("__s")))  # bounded: most_languages rows
    some = docs.join(parts, "lang").where(F.shiftrightunsigned(key, 2) <= F.col("__s"))
    at = F.pmod(key, F.greatest(F.length("text") - longest + 1, F.lit(1))).cast("int") + 1
    some = some.withColumn("__k", key).withColumn("text", F.substring(F.col("text"), at, F.lit(longest))).where(F.col("text").rlike(r"\p{L}"))
    w = F.row_number().over(W.partitionBy("lang").orderBy("__k", "doc_id", "text"))
    return [(r[0], r[1]) for r in some.withColumn("__r", w).where(F.col("__r") <= per_language).orderBy("lang", "__r").select("lang", "text").collect()]


def fit(labelled: DataFrame, per_language: int = 300, longest: int = 20_000, landmarks_per_language: int = 24, ridge: float = 1e-2, most_languages: int = 200, most_entries: int = 1 << 25) -> Model | None:
    """Learn from (doc_id, text, lang); rows of null text or lang, and texts without a letter, are left out. Bounded sample:
    per_language texts, longer ones by a piece of `longest` characters, of each of the most_languages most frequent values of lang. Ties of the
    sampling hash are settled by doc_id, then text; repeated rows count each. None if nothing is left, as of an empty table."""
    rows = sample(labelled.select("doc_id", "text", "lang").where("lang is not null"), per_language, longest, most_languages)
    return train(rows, landmarks_per_language, ridge, most_entries)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs, with lang_pred and score (0 to 1; columns of these names are replaced).

    Whole texts are scored. `und` with score 0 for a null text, a text without a letter, and for all rows if nothing could be
    learned. The score is the best language's regression value, cut to 0 to 1 (about 0 for a text unlike all of them); equal values go to the first
    language in order.
    Repeated rows are scored each. Empty tables give no rows.
    No shuffle; memory is a block of about 1 MB of text.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    docs = without(docs, ["lang_pred", "score"])
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: n-grams of a bounded sample

    def make():
        import numpy as np

        m = shared.value
        maker = Presence(m.columns) if m else None

        def run(batches):
            for b in chunks(batches, "text", 1 << 20):
                texts = b.column("text").to_pylist()
                named, score = ["und"] * len(texts), np.zeros(len(texts))
                ok = [i for i, t in enumerate(texts) if m and t and any(map(str.isalpha, t))]
                for a in range(0, len(ok), 256):
                    rows = ok[a : a + 256]
                    p, n = maker.block([texts[i] for i in rows])
                    values = ((p @ m.landmarks) / np.sqrt(np.maximum(n, 1)[:, None] * m.sizes)) @ m.weights
                    best = values.argmax(axis=1)
                    score[rows] = np.clip(values[np.arange(len(rows)), best], 0, 1)
                    for i, k in zip(rows, best):
                        named[i] = m.languages[k]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(named, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

        return run

    return map_arrow(docs, make, schema)
