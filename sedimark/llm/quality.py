"""Quality and toxicity by co-training of two views: the text's content, and the page's metadata.

The text view sees words and layout, the page view source, language and length as the table states them; neither sees what the other
does. In each round a view labels the documents of a pool that it is surest of, and these go to the other view's training rows.
Afterwards both views are calibrated on labelled rows kept out of training, a joint calibration weighs them against each other, and every
document is scored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimark.llm.common import checkpointed, chunks, map_arrow, removed, without, written

TASKS = ("quality", "toxic")
#: bytes -> words: ASCII letters in lower case, all other ASCII a blank, bytes of longer characters as they are
WORDS = bytes(c if c >= 128 else (c | 32 if chr(c).isalpha() else 32) for c in range(256))


BEGINNINGS = (4, 5, 6, 7)


def terms(words) -> set[bytes]:
    """The distinct words of a text and, after a mark, their first few bytes: stems carry meaning where words are compounds."""
    out = set(words)
    for n in BEGINNINGS:
        out |= {b"^" + w[:n] for w in words if len(w) > n}
    return out


def word_view(text: bytes, vocabulary: dict[bytes, int], stems: list[tuple[int, dict[bytes, int]]]):
    """A flag for each term of the vocabulary, and how varied the words are."""
    import numpy as np

    words = text.translate(WORDS).split()
    n = len(words)
    out = np.zeros(len(vocabulary) + 4, "f4")
    if not n:
        return out
    count = Counter(words)
    distinct = count.keys()
    for w in distinct & vocabulary.keys():
        out[vocabulary[w]] = 1
    for size, known in stems:
        for w in {w[:size] for w in distinct} & known.keys():
            out[known[w]] = 1
    top = max(count.values())
    out[-4:] = len(count) / n**0.75, top / n, top / n**0.5, np.log1p(n)
    return out


def layout(text: bytes):
    """Numbers of a text's layout: length, case, signs, digits, lines and gaps."""
    n = max(1, len(text))
    lines = text.count(b"\n") + 1
    upper = n - len(text.translate(None, UPPER))
    signs = n - len(text.translate(None, SIGNS))
    digits = n - len(text.translate(None, DIGITS))
    blank = text.count(b" ") + lines
    return (float(len(text)), upper / n, signs / n, digits / n, n / lines, n / blank, text.count(b"|") / n, text.count(b"!") / n, (text.count(b".") + text.count(b",")) / n)


UPPER, DIGITS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@[\\]^_`{|}~!?:;()\"'"


class Logistic:
    """Ridge logistic regression by Newton steps over sums that blocks of rows add up to; rows may be weighted."""

    def __init__(self, ridge: float = 1.0) -> None:
        self.ridge, self.b, self.done = ridge, None, False

    def standard(self, n, first, second):
        """From here on columns are taken by mean and deviation, of n rows with these sums of values and squares; coefficients are carried over."""
        import numpy as np

        mean, scale = first / n, np.maximum(np.sqrt(np.maximum(second / n - (first / n) ** 2, 0)), 1e-6)
        if self.b is None:
            self.b = np.zeros(len(mean) + 1)
        else:
            raw = self.b[:-1] / self.scale
            self.b = np.append(raw * scale, self.b[-1] + raw @ (mean - self.mean))
        self.mean, self.scale, self.done = mean, scale, False
        return self

    def sums(self, x, y, weight):
        """Curvature and slope of a block, one array."""
        import numpy as np

        z = np.column_stack([(np.asarray(x, "f8") - self.mean) / self.scale, np.ones(len(x))])
        p = 1 / (1 + np.exp(-np.clip(z @ self.b, -30, 30)))
        half = (z * np.sqrt(weight * p * (1 - p))[:, None]).astype("f4")
        return np.column_stack([(half.T @ half).astype("f8"), z.T @ (weight * (p - y))])

    def step(self, sums):
        import numpy as np

        pull = np.full(len(self.b), self.ridge)
        pull[-1] = 1e-3
        move = np.linalg.solve(sums[:, :-1] + np.diag(pull + 1e-9), sums[:, -1] + pull * self.b)
        self.b = self.b - move
        self.done = np.abs(move).max() < 1e-4

    def logit(self, x):
        import numpy as np

        return np.clip((np.asarray(x, "f8") - self.mean) / self.scale @ self.b[:-1] + self.b[-1], -30, 30)


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    edges: list  # of each layout number
    lengths: object  # edges of the stated length
    categories: dict[str, int]
    tasks: dict[str, tuple]  # task -> (text classifier, page classifier, joint calibration)
    views: dict[str, tuple]  # task -> (calibration of text, of page)

    def pages(self, rows):
        """Bins of the stated length (one for none) and the categories, for rows of (text, source, lang, n_chars)."""
        import numpy as np

        rows = list(rows)
        width = len(self.lengths) + 2
        out = np.zeros((len(rows), width + len(self.categories)), "f4")
        for k, (_, source, lang, n) in enumerate(rows):
            out[k, width - 1 if n is None else np.searchsorted(self.lengths, n)] = 1
            for c in (f"source {source}", f"lang {lang}"):
                if c in self.categories:
                    out[k, width + self.categories[c]] = 1
        return out

    def words(self, texts):
        """Word flags and one-hot bins of the layout numbers."""
        import numpy as np

        stems = [(n, {w[1:]: i for w, i in self.vocabulary.items() if w[:1] == b"^" and len(w) == n + 1}) for n in BEGINNINGS]
        flags = np.array([word_view(t, self.vocabulary, stems) for t in texts]).reshape(-1, len(self.vocabulary) + 4)
        numbers = np.array([layout(t) for t in texts], "f8").reshape(len(flags), -1)
        bins, at = np.zeros((len(flags), sum(len(e) + 1 for e in self.edges)), "f4"), 0
        for i, e in enumerate(self.edges):
            bins[np.arange(len(flags)), at + np.searchsorted(e, numbers[:, i])] = 1
            at += len(e) + 1
        return np.concatenate([flags, bins], axis=1)

    def certainty(self, rows):
        """task -> calibrated probabilities by text and by page."""
        return self.probabilities(self.words([r[0] for r in rows]), self.pages(rows))

    def probabilities(self, words, pages):
        import numpy as np

        squash = lambda z: 1 / (1 + np.exp(-z))
        return {t: tuple(squash(c.logit(f.logit(x)[:, None])) for f, c, x in zip(fitted[:2], self.views[t], (words, pages))) for t, fitted in self.tasks.items()}

    def score(self, rows):
        """task -> (calibrated probability by words, by page, jointly)."""
        import numpy as np

        squash = lambda z: 1 / (1 + np.exp(-z))
        words, pages, out = self.words([r[0] for r in rows]), self.pages(rows), {}
        for t, (a, b, joint) in self.tasks.items():
            za, zb = a.logit(words), b.logit(pages)
            ca, cb = self.views[t]
            out[t] = squash(ca.logit(za[:, None])), squash(cb.logit(zb[:, None])), squash(joint.logit(np.column_stack([za, zb])))
        return out


def counted(blocks, most: int = 1 << 18):
    """Blocks of (texts, task -> targets) -> Counters of the terms' documents: of all, and of each task's hits. Given out when they hold
    `most` terms."""
    total, hits = Counter(), [Counter() for _ in TASKS]
    for texts, targets in blocks:
        for i, text in enumerate(texts):
            bag = terms(set(text.translate(WORDS).split()))
            total.update(bag)
            for h, t in zip(hits, TASKS):
                if targets[t][i]:
                    h.update(bag)
            if len(total) >= most:
                yield total, hits
                total, hits = Counter(), [Counter() for _ in TASKS]
    yield total, hits


class Rows:
    """Labelled rows in memory: (text bytes, source, lang, n_chars) and task -> 0/1 of each. A fifth is kept for calibration."""

    def __init__(self, rows, targets) -> None:
        import numpy as np

        self.rows, self.kept, self.targets = rows, np.arange(len(rows)) % 5 == 4, targets
        self.use = np.flatnonzero(~self.kept)

    def vocabulary(self, words: int) -> list[bytes]:
        rate = {t: _rate(self.targets[t][self.use].mean()) for t in TASKS}
        ((total, hits),) = counted([([self.rows[i][0] for i in self.use], {t: self.targets[t][self.use] for t in TASKS})], 1 << 62)
        best = {w: max(abs(h[w] - n * rate[t]) / (n * rate[t] * (1 - rate[t]) + 1) ** 0.5 for h, t in zip(hits, TASKS)) for w, n in total.items() if n >= 5}
        return [w for w, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:words]]

    def edges(self, bins: int):
        import numpy as np

        cuts = lambda x: np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)
        numbers = np.array([layout(self.rows[i][0]) for i in self.use])
        return [cuts(c) for c in numbers.T], cuts(np.array([self.rows[i][3] for i in self.use if self.rows[i][3] is not None], "f8"))

    def groups(self):
        return Counter(c for i in self.use for c in (f"source {self.rows[i][1]}", f"lang {self.rows[i][2]}"))

    def ready(self, model: Model) -> None:
        self.views = (model.words([r[0] for r in self.rows]), model.pages(self.rows))

    def total(self, part) -> list:
        return part(self.views, self.targets, self.kept)


def _rate(x: float) -> float:
    return min(max(x, 1e-3), 1 - 1e-3)


def train(rows, targets, confident=None, words: int = 300, bins: int = 12, rounds: int = 3) -> Model:
    """The model of labelled rows in memory, see fitted."""
    return fitted(Rows(rows, targets), confident, lambda m, r: (m.words([r[0]]), m.pages([r])), words, bins, rounds)


def fitted(data, confident, views_of, words: int = 300, bins: int = 12, rounds: int = 3) -> Model:
    """A model of all of data (Rows or Spread). The vocabulary is the terms most associated with either target, by a signed-root chi-square
    over documents; the page view knows the 64 most frequent values of source and language, others are unknown to it. confident: a
    function from the round's model to (task, view, label, row) of the pool's documents that a view is surest of and has not handed over
    yet; they join the other view's training rows at half weight. views_of(model, row): that row's features."""
    import numpy as np

    known = sorted(data.groups().items(), key=lambda x: (-x[1], x[0]))[:64]
    edges, lengths = data.edges(bins)
    model = Model({w: i for i, w in enumerate(data.vocabulary(words))}, edges, lengths, {c: k for k, (c, _) in enumerate(known)}, {}, {})
    data.ready(model)
    extra: dict[tuple, list] = {(t, v): [] for t in TASKS for v in (0, 1)}  # (features, label) of rows handed to a view
    main = {(t, v): Logistic(3.0) for t in TASKS for v in (0, 1)}

    def moments(views, targets, kept):
        return [x for v in views for u in [v[~kept].astype("f8")] for x in (np.array(float(len(u))), u.sum(axis=0), (u**2).sum(axis=0))]

    base = data.total(moments)

    def settle(fits, inputs, held, extra=(), steps: int = 12):
        """Newton steps of all fits at once, one pass each, until none moves."""
        for _ in range(steps):
            todo = [k for k in fits if not fits[k].done]
            if not todo:
                break
            now = {k: fits[k] for k in todo}

            def part(views, targets, kept, now=now):
                at = kept if held else ~kept
                x = inputs(views, at)
                return [f.sums(x[k], targets[k[0]][at], np.ones(int(at.sum()))) for k, f in now.items()]

            for k, got in zip(todo, data.total(part)):
                if extra and extra[k]:
                    x, y = (np.concatenate(z) for z in zip(*extra[k]))
                    got = got + fits[k].sums(x, y, np.full(len(y), 0.5))
                fits[k].step(got)

    for r in range(rounds + 1):
        for (t, v), f in main.items():
            more = np.concatenate([m[0] for m in extra[(t, v)]]).astype("f8") if extra[(t, v)] else np.zeros((0, len(base[3 * v + 1])))
            f.standard(base[3 * v] + len(more), base[3 * v + 1] + more.sum(axis=0), base[3 * v + 2] + (more**2).sum(axis=0))
        settle(main, lambda views, at: {k: views[k[1]][at] for k in main}, False, extra)
        raw = lambda views, at: {(t, v): main[(t, v)].logit(views[v][at])[:, None] for t in TASKS for v in (0, 1)}

        def logits(views, at):
            z = raw(views, at)
            return z | {(t, 2): np.column_stack([z[(t, 0)], z[(t, 1)]]) for t in TASKS}

        small = {(t, v): Logistic(0.1) for t in TASKS for v in (0, 1, 2)}

        def spread(views, targets, kept):
            z = logits(views, kept)
            return [x for k in small for x in (np.array(float(len(z[k]))), z[k].sum(axis=0), (z[k] ** 2).sum(axis=0))]

        got = data.total(spread)
        for i, f in enumerate(small.values()):
            f.standard(*got[3 * i : 3 * i + 3])
        settle(small, logits, True)
        for t in TASKS:
            model.views[t] = (small[(t, 0)], small[(t, 1)])
            model.tasks[t] = (main[(t, 0)], main[(t, 1)], small[(t, 2)])
        if r == rounds or confident is None:
            break
        for t, v, label, row in confident(model):
            extra[(t, 1 - v)].append((views_of(model, row)[1 - v], np.array([float(label)])))
    return model


def _read(model: Model, rows):
    return model.words([r[0] for r in rows]), model.pages(rows)


def _unpacked(model: Model, rows):
    """Features of rows (on, rest, page): numbers of the flags that are set, the other columns, numbers of the page's flags."""
    import numpy as np

    n, width = len(model.vocabulary), sum(len(e) + 1 for e in model.edges) + 4
    words = np.zeros((len(rows), n + width), "f4")
    pages = np.zeros((len(rows), len(model.lengths) + 2 + len(model.categories)), "f4")
    for out, k in ((words, 0), (pages, 2)):
        at = [np.frombuffer(r[k], "<u2") for r in rows]
        if at:
            out[np.repeat(np.arange(len(rows)), [len(x) for x in at]), np.concatenate(at)] = 1
    if rows:
        words[:, n : n + 4] = np.frombuffer(b"".join(r[1] for r in rows), "<f4").reshape(-1, 4)
    return words, pages


def _packed(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, key and the features of every row, as _unpacked reads them: texts are read once, whatever the number of rounds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training parameters

    def make():
        import numpy as np
        import pyarrow as pa

        m = shared.value
        n = len(m.vocabulary)

        def run(batches):
            for b in chunks(batches, "text", 1 << 20):
                rows = list(zip(b.column("text").to_pylist(), *(b.column(c).to_pylist() for c in ("source", "lang", "n_chars"))))
                words, pages = _read(m, rows)
                rest = [x.tobytes() for x in words[:, n : n + 4].astype("<f4")]
                words[:, n : n + 4] = 0
                on, page = ([np.flatnonzero(x).astype("<u2").tobytes() for x in f] for f in (words, pages))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *(pa.array(x, pa.binary()) for x in (on, rest, page))], ["doc_id", "key", "on", "rest", "page"])

        return run

    return map_arrow(docs, make, "doc_id long, key long, on binary, rest binary, page binary")


def _confident(pool: DataFrame, sure: float, most: int, read=_read):
    """A function from a model to the pool's surest rows, (task, view, label, row), each handed over once per task, view and label; at most
    `most` of each per round, the surest first. A row is the pool's columns without key; read(model, rows) gives both views' features.
    The pool is scored where it lies; only those rows reach the driver."""
    given: dict[tuple, set] = {}
    columns = [c for c in pool.columns if c != "key"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema.fields if f.name != "key")

    def pick(model: Model):
        import pyarrow as pa

        shared = pool.sparkSession.sparkContext.broadcast((model, {k: set(v) for k, v in given.items()}))  # bounded by rounds and `most`

        def make():
            import numpy as np

            m, old = shared.value

            def run(batches):
                for b in chunks(batches, columns[0], 1 << 20):
                    keys = b.column("key").to_numpy()
                    rows = list(zip(*(b.column(c).to_pylist() for c in columns)))
                    out: list[tuple] = []
                    for t, probs in m.probabilities(*read(m, rows)).items():
                        for v, p in enumerate(probs):
                            for label, certain in ((1, p), (0, 1 - p)):
                                gone = old.get((t, v, label), set())
                                at = [i for i in np.argsort(-certain, kind="stable") if certain[i] >= sure and int(keys[i]) not in gone][:most]
                                out += [(f"{t} {v} {label}", float(certain[i]), int(i)) for i in at]
                    if out:
                        rows_ = b.select(["key", *columns]).take(pa.array([i for _, _, i in out]))
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), *rows_.columns], ["slot", "certain", *rows_.schema.names])

            return run

        found = map_arrow(pool, make, f"slot string, certain double, key long, {kinds}")
        once = W.partitionBy("slot", "key").orderBy(F.desc("certain"), *columns[1:])  # copies of a text are handed over once
        w = W.partitionBy("slot").orderBy(F.desc("certain"), "key")
        found = found.withColumn("__d", F.row_number().over(once)).where("__d = 1")
        for r in found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).orderBy("slot", "__r").collect():
            t, v, label = r.slot.split(" ")
            given.setdefault((t, int(v), int(label)), set()).add(r.key)
            yield t, int(v), int(label), tuple(bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for c in columns)

    return pick


class Spread:
    """Labelled rows as tables: texts (doc_id, text, source, lang, n_chars, key, targets, kept) and the features of all documents."""

    def __init__(self, texts: DataFrame, docs: DataFrame, known: DataFrame, exchange: int, sure: float) -> None:
        self.texts, self.use, self.docs, self.known = texts, texts.where("not kept"), docs, known
        self.exchange, self.sure = exchange, sure

    def vocabulary(self, words: int) -> list[bytes]:
        rate = self.use.agg(*[F.avg(t).alias(t) for t in TASKS]).first()

        def make():
            import pyarrow as pa

            def run(batches):
                blocks = ((b.column("text").to_pylist(), {t: b.column(t).to_pylist() for t in TASKS}) for b in batches)
                for total, hits in counted(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64()), *(pa.array([h[w] for w in total], pa.int64()) for h in hits)], ["term", "n", *TASKS])

            return run

        found = map_arrow(self.use.select("text", *TASKS), make, "term binary, n long, " + ", ".join(f"{t} long" for t in TASKS))
        found = found.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", *TASKS)]).where("n >= 5")
        by = [F.abs(F.col(t) - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)) + 1) for t in TASKS for p in [_rate(rate[t])]]
        return [bytes(r.term) for r in found.orderBy(F.greatest(*by).desc(), "term").limit(words).select("term").collect()]

    def edges(self, bins: int):
        """Quantiles of all rows by Spark's summaries: off by a ten-thousandth of the rows at most."""
        import numpy as np

        def make():
            import pyarrow as pa

            def run(batches):
                for b in batches:
                    numbers = np.array([layout(t) for t in b.column("text").to_pylist()], "f8").reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in numbers.T], [f"c{k}" for k in range(numbers.shape[1])])

            return run

        at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
        n = len(layout(b""))
        got = map_arrow(self.use.select("text"), make, ", ".join(f"c{k} double" for k in range(n))).agg(*[F.percentile_approx(f"c{k}", at, 10_000).alias(f"c{k}") for k in range(n)]).first()
        lengths = self.use.agg(F.percentile_approx(F.col("n_chars").cast("double"), at, 10_000)).first()[0]
        return [np.unique(x) for x in got], np.unique(lengths or np.zeros(0))

    def groups(self):
        return {f"{c} {r[0]}": r[1] for c in ("source", "lang") for r in self.use.groupBy(c).count().orderBy(F.desc("count"), c).limit(64).collect()}

    def ready(self, model: Model) -> None:
        """Features of all documents, once; labelled ones are told by their targets."""
        joined = _packed(self.docs, model).join(self.known, "doc_id", "left").withColumn("kept", _kept())
        joined = joined.withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy("key")))
        rows = checkpointed(joined.where(f"{TASKS[0]} is null or __r = 1").drop("doc_id", "__r"))
        # a pass adds up in each task and sends one sum of fixed size: as many tasks as there are cores
        self.rows = rows.where(F.col(TASKS[0]).isNotNull()).coalesce(rows.sparkSession.sparkContext.defaultParallelism)
        self.pool = rows.where(F.col(TASKS[0]).isNull()).select("key", "on", "rest", "page")
        self.model = Model(model.vocabulary, model.edges, model.lengths, model.categories, {}, {})
        self.confident = _confident(self.pool, self.sure, self.exchange, _unpacked)

    def total(self, part) -> list:
        import pickle

        shared = self.model

        def make():
            import numpy as np
            import pyarrow as pa

            def run(batches):
                out = None
                for b in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
                    views = _unpacked(shared, list(zip(*(b.column(c).to_pylist() for c in ("on", "rest", "page")))))
                    got = part(views, {t: b.column(t).to_numpy().astype("f8") for t in TASKS}, b.column("kept").to_numpy(zero_copy_only=False))
                    out = got if out is None else [x + y for x, y in zip(out, got)]
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([np.asarray(x) for x in out])], pa.binary())], ["sums"])

            return run

        found = [pickle.loads(r.sums) for r in map_arrow(self.rows, make, "sums binary").collect()]
        return [sum(x) for x in zip(*found)]


def _kept():
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(5)) == 4


def labelled(docs: DataFrame, known: DataFrame, bits: int = 24) -> DataFrame:
    """The docs whose doc_id is in known, with its columns. Before the join most other texts are left out by a bitmap of 2**bits hashes
    of the ids (a fixed 2 MB), so that they aren't shuffled; the join decides."""
    import numpy as np

    slot = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("map")), 64 - bits)
    words = known.select(slot.alias("s")).groupBy(F.shiftrightunsigned("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).collect()
    held = np.zeros(1 << (bits - 6), "i8")
    held[[r.w for r in words]] = [r.b for r in words]
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def make():
        import pyarrow as pa

        def run(batches):
            for b in batches:
                s = b.column("__s").to_numpy()
                yield b.filter(pa.array((shared.value[s >> 6] >> (s & 63)) & 1 == 1))

        return run

    some = docs.where("doc_id is not null").withColumn("__s", slot)
    return map_arrow(some, make, some.schema).drop("__s").join(known, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, exchange: int = 150, sure: float = 0.97) -> Model | None:
    """Learns from every labelled document (null labels left out; of repeated doc_ids one label and one text, that of the smallest hash);
    the pool is every document without a label, scored in each round; `exchange` bounds what a view hands over per round, task and label.
    Whole texts are read, null texts take no part. Term counts, quantiles and Newton steps are sums over tasks; the driver holds one sum of fixed size per
    core. None if no row or one class only is there, as with empty tables."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.select("doc_id", *[(F.col(t) > 0).cast("int").alias(t) for t in TASKS])
    cols = [F.col("text").cast("binary").alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), F.xxhash64("text").alias("key")]
    docs = docs.where(F.col("text").isNotNull()).select("doc_id", *cols)
    got = labelled(docs, known).withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy("key", "text"))).where("__r = 1").drop("__r")
    texts = written(got.withColumn("kept", _kept()), "labelled")
    some = texts.groupBy("kept").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TASKS]).collect()
    try:
        if sum(r.n for r in some) < 20 or len(some) < 2 or any(r[t] in (0, r.n) for t in TASKS for r in some if not r.kept):
            return None
        data = Spread(texts, docs, known, exchange, sure)
        return fitted(data, lambda model: data.confident(model), lambda model, row: _unpacked(model, [row]))
    finally:
        removed(docs.sparkSession, texts.inputFiles()[0].rsplit("/", 1)[0]) if texts.inputFiles() else None


def score(docs: DataFrame, model: Model | None, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """All columns of docs and: quality_words, quality_page, quality_score, toxic_words, toxic_page, toxic_score (calibrated
    probabilities by view and jointly), keep boolean (quality_score >= least_quality and toxic_score < most_toxic).

    Whole texts are scored; a null text is empty; null metadata count as unknown. An empty text is scored by the same rule.
    Without a model (nothing to learn from) the scores are null and all rows are kept. Repeated rows are scored each;
    columns of these names are replaced; an empty table gives no rows. No shuffle.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    names = ["quality_words", "quality_page", "quality_score", "toxic_words", "toxic_page", "toxic_score"]
    docs = without(docs, [*names, "keep"])
    schema = StructType(list(docs.schema.fields))
    for c in names:
        schema = schema.add(c, "double")
    schema = schema.add("keep", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training parameters

    def make():
        m = shared.value

        def run(batches):
            for b in chunks(batches, "text", 1 << 20):
                if m is None:
                    values, keep = [pa.nulls(b.num_rows, pa.float64())] * 6, pa.array([True] * b.num_rows)
                else:
                    texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
                    meta = [b.column(c).to_pylist() if c in b.schema.names else [None] * len(texts) for c in ("source", "lang", "n_chars")]
                    got = m.score(list(zip(texts, *meta)))
                    keep = pa.array((got["quality"][2] >= least_quality) & (got["toxic"][2] < most_toxic))
                    values = [pa.array(v) for t in TASKS for v in got[t]]
                yield pa.RecordBatch.from_arrays([*b.columns, *values, keep], [*b.schema.names, *names, "keep"])

        return run

    return map_arrow(docs, make, schema)
