"""Documents that tell a structure's coordinates: mentions of atoms from coarse to fine, or boxes first and then crops of boxes.

An entry is one row (its residues are fewer than the position indices, so its size has a bound) and one document. All draws of an entry come
from a generator that its own id seeds: results don't depend on partitions. Readers give mentions back as rows, by built-in functions.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the document formats.
COORDINATES, CROPS = "<contacts-and-coordinates-v1>", "<contacts-and-crops-v1>"
SEQUENCE, STATEMENTS, END, FIRST, LAST, CONTACT, CROP = "<begin_sequence>", "<begin_statements>", "<end>", "<n-term>", "<c-term>", "<contact>", "<crop>"
PLACES = (100.0, 10.0, 1.0, 0.1)
FRAME = 8  # tokens besides two per residue: the kind, three marks, two ends of two tokens

OUT = "document string, n_tokens long, n_contacts long, n_mentions long, n_crops long, truncated boolean, quaternion array<double>, shift array<double>"


@dataclass(frozen=True)
class Layout:
    """Parameters of both formats. `depth` is the number of decimal places of a coordinate mention (hundreds first); `noise` false leaves
    places as they are; `each` tells every atom once, as finely as can be (of crops: every box that holds one), before any is drawn; `reserve` is what the boxes leave to the crops; a crop is chosen by the box of a random atom, by a neighbour of
    boxes seen, or else by how often a box was seen."""

    context: int = 8192
    positions: int = 2000
    least_gap: int = 6
    least_degree: float = 0.001
    no_contacts: float = 0.3
    most_contacts: int = 50
    cube: float = 1000.0
    margin: float = 10.0
    depth: int = 3
    floor_weight: float = 0.05
    noise: bool = True
    each: bool = False
    reserve: int = 2000
    box_noise: float = 2.0
    by_atom: float = 0.45
    by_neighbour: float = 0.45
    crop_noise: float = 1.0
    keep: float = 0.99


def entries(residues: DataFrame, atoms: DataFrame, contacts: DataFrame) -> DataFrame:
    """entry_id, residues array<string>, atoms array<struct<i,atom,x,y,z>>, contacts array<struct<i,j,degree>> from rows (entry_id, i, name),
    (entry_id, i, atom, x, y, z) and (entry_id, i, j, degree). Atoms with a missing coordinate are left out."""
    r = residues.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda s: s["name"]).alias("residues"))
    whole = " and ".join(f"{c} is not null and not isnan({c})" for c in "xyz")
    a = atoms.where(whole).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("i", "atom", "x", "y", "z"))).alias("atoms"))
    c = contacts.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "degree"))).alias("contacts"))
    out = r.join(a, "entry_id", "left").join(c, "entry_id", "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast(t)) for n, t in (("atoms", a.schema["atoms"].dataType), ("contacts", c.schema["contacts"].dataType))})


def rotation(q):
    """The matrix of a unit quaternion (w, x, y, z); rows are turned by x @ matrix.T."""
    import numpy as np

    w, v = q[0], np.asarray(q[1:], float)
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + 2 * w * cross + 2 * cross @ cross


def digits(values, places: int):
    """Decimal digits of coordinates, coarsest first, after cutting them to what the places can say; ties to even."""
    import numpy as np

    scale, top = 10.0 ** (places - 3), 10**places - 1
    whole = np.rint(np.clip(values, 0.0, top / scale) * scale).astype("i8")
    return np.stack([whole // 10 ** (places - 1 - k) % 10 for k in range(places)])


TRIPLES = [f"<xyz-{k:03d}>" for k in range(1000)]


def triples(d):
    """Digits (..., 3) of x, y, z at one place as the numbers of their tokens."""
    return d[..., 0] * 100 + d[..., 1] * 10 + d[..., 2]


class _Entry:
    """What both formats share: numbering, sequence section, frame and contacts of one entry."""

    def __init__(self, key: str, residues: list[str], atoms: list, contacts: list, at: Layout):
        import numpy as np

        self.at, self.rng = at, np.random.default_rng(int(hashlib.sha1(key.encode()).hexdigest(), 16))
        n = len(residues)
        self.fits = 2 <= n <= at.positions and FRAME + 2 * n <= at.context
        if not self.fits:
            return
        start = int(self.rng.integers(at.positions))
        self.place = [f"<p{(start + k) % at.positions}>" for k in range(n)]
        told = [f"{p} <{r}>" for p, r in zip(self.place, residues)] + [f"{FIRST} {self.place[0]}", f"{LAST} {self.place[-1]}"]
        self.sequence = [told[k] for k in self.rng.permutation(n + 2)]
        self.who = [(int(a["i"]), a["atom"]) for a in atoms if 0 <= a["i"] < n]
        xyz = np.array([[a["x"], a["y"], a["z"]] for a in atoms if 0 <= a["i"] < n], float).reshape(-1, 3)
        self.quaternion, self.shift = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
        if len(xyz):
            q = self.rng.normal(size=4)
            q /= np.linalg.norm(q)
            xyz = (xyz - xyz.mean(0)) @ rotation(q).T
            room = at.cube - 2 * at.margin - np.ptp(xyz, axis=0)
            self.fits = bool((room >= 0).all())
            shift = at.margin + self.rng.random(3) * room - xyz.min(0)
            xyz, self.quaternion, self.shift = xyz + shift, q.tolist(), shift.tolist()
        self.xyz = xyz
        able = [(int(c["i"]), int(c["j"])) for c in contacts if c["j"] - c["i"] >= at.least_gap and c["degree"] >= at.least_degree and 0 <= c["i"] and c["j"] < n]
        none, most, coins = self.rng.random() < at.no_contacts, min(at.most_contacts, len(able)), self.rng.random(at.most_contacts) < 0.5
        chosen = [] if none or not most else [able[k] for k in self.rng.permutation(len(able))[: int(self.rng.integers(1, most + 1))]]
        self.contacts = [f"{CONTACT} {self.place[j]} {self.place[i]}" if turn else f"{CONTACT} {self.place[i]} {self.place[j]}" for (i, j), turn in zip(chosen, coins)]
        self.room = max(0, at.context - FRAME - 2 * n - 3 * len(self.contacts))

        self.named = [f"{self.place[i]} <{atom}>" for i, atom in self.who]

    def mention(self, k: int, numbers: list[int]) -> str:
        return " ".join([self.named[k], *[TRIPLES[n] for n in numbers]])

    def written(self, kind: str, body: list[str], n_mentions: int, n_crops: int, truncated: bool) -> dict:
        text = " ".join([kind, SEQUENCE, *self.sequence, STATEMENTS, *self.contacts, *body, END])
        return {"document": text, "n_tokens": text.count(" ") + 1, "n_contacts": len(self.contacts), "n_mentions": n_mentions, "n_crops": n_crops, "truncated": truncated, "quaternion": self.quaternion, "shift": self.shift}


def _coordinates(e: _Entry) -> dict:
    """Mentions of atoms drawn with return. The share of the room that is used up moves the weight from the coarsest depth to the finest; the
    first mention (with `each` the first of every atom) is as fine as can be; the first that doesn't fit ends the document."""
    import numpy as np

    at, body, used, n = e.at, [], 0, len(e.xyz)
    events = e.room // 3 if n else 0
    atoms, draws, noise = e.rng.integers(max(n, 1), size=events), e.rng.random(events), e.rng.normal(size=(events, 3))
    first = min(n, events) if at.each else 1
    if at.each:
        atoms[:first] = e.rng.permutation(n)[:first]
    told = [triples(digits(e.xyz[atoms] + (noise * PLACES[d] / 4 if at.noise else 0), at.depth)).T.tolist() if events else [] for d in range(at.depth)]
    centres, truncated = [d / (at.depth - 1) if at.depth > 1 else 0.0 for d in range(at.depth)], False
    for k, (atom, draw) in enumerate(zip(atoms.tolist(), draws.tolist())):
        weight = [max(0.0, 1 - 3 * abs(used / e.room - c)) + at.floor_weight for c in centres]
        depth, rest = 1, draw * sum(weight) - weight[0]
        while rest >= 0 and depth < at.depth:
            rest -= weight[depth]
            depth += 1
        depth = at.depth if k < first else depth
        if used + 2 + depth > e.room:
            truncated = True
            break
        body.append(e.mention(atom, told[depth - 1][k][:depth]))
        used += 2 + depth
    return e.written(COORDINATES, body, len(body), 0, truncated)


def _crops(e: _Entry) -> dict:
    """First boxes of ten units for atoms, residues seen before being rarer; then crops: a box and, in random order, what lies in it to a tenth.

    Atoms of the box and of its 26 neighbours are tried with noise that shrinks with the visits to the box; those that fall into it are told.
    The last crop may be cut by the room. With `each`, the boxes that hold atoms come first, each once, in random order."""
    import numpy as np

    at, body, used, n = e.at, [], 0, len(e.xyz)
    if not n:
        return e.written(CROPS, body, 0, 0, False)
    chosen = _drawn_boxes(e, max(0, (e.room - at.reserve) // 4))
    used += 4 * len(chosen)
    exact = digits(e.xyz, 4)
    own, places = list(map(tuple, (exact[0] * 10 + exact[1]).tolist())), triples(exact).T.tolist()
    off = e.rng.normal(size=(len(chosen), 3)) * at.box_noise
    if at.noise:
        body += [e.mention(k, t) for k, t in zip(chosen, triples(digits(e.xyz[chosen] + off, 4))[:2].T.tolist())] if chosen else []
    else:
        boxes = [e.mention(k, t[:2]) for k, t in enumerate(places)]
        body += [boxes[k] for k in chosen]
    n_mentions, told_exactly = len(body), [e.mention(k, t[2:]) for k, t in enumerate(places)]
    inside: dict[tuple, list[int]] = {}
    for k, b in enumerate(own):
        inside.setdefault(b, []).append(k)
    known: dict[tuple, tuple] = {}

    def seen_from(b):
        """Of a box: the boxes around it and its header, the atoms of both, and where its own come among those."""
        x, y, z = b
        around = [(i, j, k) for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1) for k in (z - 1, z, z + 1)]
        met = [inside[c] if c in inside else [] for c in around]
        head = " ".join([CROP, TRIPLES[b[0] // 10 * 100 + b[1] // 10 * 10 + b[2] // 10], TRIPLES[b[0] % 10 * 100 + b[1] % 10 * 10 + b[2] % 10]])
        return around, head, [k for m in met for k in m], sum(map(len, met[:13]))

    visits: dict[tuple, int] = {}
    edge: dict[tuple, None] = {}
    n_crops, truncated = 0, False
    first = [list(inside)[k] for k in e.rng.permutation(len(inside))] if at.each else []
    while used + 3 <= e.room and not truncated:
        coin, pick = e.rng.random(), e.rng.random()
        if n_crops < len(first):
            box = first[n_crops]
        elif not visits or coin < at.by_atom or (coin < at.by_atom + at.by_neighbour and not edge):
            box = own[int(pick * n)]
        elif coin < at.by_atom + at.by_neighbour:
            box = list(edge)[int(pick * len(edge))]
        else:
            weight = list(accumulate(visits.values()))
            box = list(visits)[bisect_right(weight, pick * weight[-1])]
        around, head, near, start = known.get(box) or known.setdefault(box, seen_from(box))
        told: list[str] = []
        if near and at.noise:
            off = e.rng.normal(size=(len(near), 3)) * (at.crop_noise / (visits.get(box, 0) + 1) ** 2)
            there, keep = digits(e.xyz[near] + off, 4), e.rng.random(len(near)) < at.keep
            falls = ((there[0] * 10 + there[1]) == box).all(axis=1) & keep
            if falls.any():
                told = [e.mention(near[k], d) for k, d in zip(np.flatnonzero(falls).tolist(), triples(there[:, falls]).T[:, 2:].tolist())]
        elif near:
            keep = e.rng.random(len(near)).tolist()
            told = [told_exactly[k] for k, x in zip(inside.get(box, ()), keep[start:]) if x < at.keep]
        if len(told) > 1:
            told = [told[k] for k in e.rng.permutation(len(told)).tolist()]
        fits = (e.room - used - 3) // 4
        truncated = len(told) > fits
        body.append(" ".join([head, *told[:fits]]))
        used += 3 + 4 * min(len(told), fits)
        n_crops += 1
        visits[box] = visits.get(box, 0) + 1
        edge.pop(box, None)
        if box in inside and visits[box] == 1:  # after that those around it are visited or on the edge
            edge.update({b: None for b in around if b not in visits and 0 <= b[0] < 100 and 0 <= b[1] < 100 and 0 <= b[2] < 100})
    return e.written(CROPS, body, n_mentions, n_crops, truncated)


def _drawn_boxes(e: _Entry, m: int) -> list[int]:
    """Atoms of m boxes, each drawn by 1 / (1 + how often its residue was drawn before)."""
    import numpy as np

    draws, atoms = e.rng.random(m), {}
    for k, (i, _) in enumerate(e.who):
        atoms.setdefault(i, []).append(k)
    of, n, chosen, seen = [i for i, _ in e.who], len(e.who), [], {}
    if n > 256:  # sums of long arrays
        weight = np.ones(n)
        summed, found = weight.cumsum, lambda s, x: int(np.searchsorted(s, x, "right"))
    else:
        weight = [1.0] * n
        summed, found = lambda: list(accumulate(weight)), bisect_right
    for x in draws.tolist():
        sums = summed()
        k = min(found(sums, x * sums[-1]), n - 1)
        chosen.append(k)
        seen[of[k]] = seen.get(of[k], 0) + 1
        for a in atoms[of[k]]:
            weight[a] = 1 / (1 + seen[of[k]])
    return chosen


def _documents(rows: DataFrame, at: Layout, make: Callable) -> DataFrame:
    kind = dict(rows.dtypes)["entry_id"]
    schema = f"entry_id {kind}, {OUT}"
    empty = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(empty)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["entry_id"] is not None:
                    e = _Entry(str(r["entry_id"]), r["residues"] or [], r["atoms"] or [], r["contacts"] or [], at)
                    if e.fits:
                        out.append({"entry_id": r["entry_id"], **make(e)})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return rows.select("entry_id", "residues", "atoms", "contacts").mapInArrow(run, empty)


def coordinate_documents(rows: DataFrame, at: Layout | None = None) -> DataFrame:
    """entry_id, document, n_tokens, n_contacts, n_mentions, n_crops (0), truncated, quaternion and shift of the frame, of rows as `entries` gives them.

    Entries with a null id, fewer than two residues, more than the position indices, a sequence section beyond the context or a turned structure
    beyond the cube have no document. An entry without atoms has no mentions."""
    at = at or Layout()
    if not 1 <= at.depth <= len(PLACES):
        raise ValueError("depth must be 1 to 4")
    return _documents(rows, at, _coordinates)


def crop_documents(rows: DataFrame, at: Layout | None = None) -> DataFrame:
    """As coordinate_documents, in the form of boxes and crops."""
    return _documents(rows, at or Layout(), _crops)


def _read(triples: Column, places: tuple[float, ...]) -> list[Column]:
    """x, y, z that triples of digits say, as whole tenths."""
    told = lambda p, k: F.coalesce(F.substring(F.get(triples, F.lit(p)), k + 1, 1).cast("int") * int(round(places[p] * 10)), F.lit(0))
    return [sum((told(p, k) for p in range(1, len(places))), told(0, k)) for k in range(3)]


TAKEN = "array<struct<p:int,atom:string,t:array<string>>>"


def _taken(mention: Column) -> Column:
    """The parts of a mention, taken out before rows are made of them, so that they are taken out once."""
    return F.struct(F.regexp_extract(mention, r"<p(\d+)>", 1).cast("int").alias("p"), F.regexp_extract(mention, r" <([^ <>]+)>", 1).alias("atom"), F.regexp_extract_all(mention, F.lit(r"<xyz-(\d{3})>"), F.lit(1)).alias("t"))


def coordinate_mentions(df: DataFrame, key: str = "entry_id", text: str = "document", carry: Sequence[str] = ()) -> DataFrame:
    """key, carried columns, n, p (position index), atom, depth, x, y, z (tenths) of a coordinate document's mentions, in order."""
    body = F.element_at(F.split(text, F.lit(STATEMENTS)), -1)
    found = F.regexp_extract_all(body, F.lit(r"<p\d+> <[^ <>a-z]+>(?: <xyz-\d{3}>)+"), F.lit(0))
    d = df.select(key, *carry, F.posexplode(F.transform(found, _taken).cast(TAKEN)).alias("n", "m"))
    return d.select(key, *carry, "n", "m.p", "m.atom", F.size("m.t").alias("depth"), *[v.alias(c) for c, v in zip("xyz", _read(F.col("m.t"), PLACES))])


def crop_mentions(df: DataFrame, key: str = "entry_id", text: str = "document", carry: Sequence[str] = ()) -> DataFrame:
    """key, carried columns, crop (0: the first pass), n, p, atom, box_x, box_y, box_z, x, y, z (tenths inside the box; null in the first pass) of a crop document."""
    body = F.element_at(F.split(text, F.lit(STATEMENTS)), -1)
    d = df.select(key, *carry, F.posexplode(F.split(body, F.lit(CROP))).alias("crop", "part"))
    head = F.regexp_extract_all(F.regexp_extract("part", r"^ (<xyz-\d{3}> <xyz-\d{3}>)", 1), F.lit(r"<xyz-(\d{3})>"), F.lit(1))
    found = F.regexp_extract_all("part", F.lit(r"<p\d+> <[^ <>a-z]+> <xyz-\d{3}> <xyz-\d{3}>"), F.lit(0))
    d = d.select(key, *carry, "crop", F.explode(F.array(head)).alias("head"), F.transform(found, _taken).cast(TAKEN).alias("told")).select(key, *carry, "crop", "head", F.posexplode("told").alias("n", "m"))
    own = F.col("m.t")
    boxes = [c / 100 for c in _read(F.when(F.col("crop") == 0, own).otherwise(F.col("head")), PLACES[:2])]
    inside = [F.when(F.col("crop") > 0, c) for c in _read(own, PLACES[2:])]
    return d.select(key, *carry, "crop", "n", "m.p", "m.atom", *[b.cast("int").alias(f"box_{a}") for a, b in zip("xyz", boxes)], *[c.alias(a) for a, c in zip("xyz", inside)])
