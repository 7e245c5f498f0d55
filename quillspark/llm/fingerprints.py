"""Operator 1: audio fingerprints from chroma, matched by offset histograms and bit errors.

A recording is mono PCM in a binary column (8-bit unsigned or 16-bit signed).
Frames are folded into twelve pitch classes; filters that compare areas of this
image, each from four reads of its integral image, are quantised to two bits,
and sixteen of them make the 32-bit number of a frame.

Search: every recording whose id is divisible by `QUERY_EVERY` is a query
against all. Recordings with equal samples are one class from the start. With
`every_shift`, as in the registered query, a query is also printed from each of its first samples up to a step,
so that one of these phases meets the other recording's frames wherever a shared
sound lies in it; without, shared sound is found where it lies a whole number of
steps apart, as between copies with the same beginning. A passage that many recordings share is a
match of each query that holds it with each of them, so matches grow faster than the input.
Of runs of `RUN` frame numbers a query's class and a candidate class share enough
that an offset can have `LEAST_VOTES`: votes are counted by pair and offset before
anything else moves. Their whole prints then give the histogram of offsets:
every place of every shared run votes, and every offset with `LEAST_VOTES` is
tried, from the most votes on. At an offset the stretch of frames is taken that
stands out most (the maximal sum of what each frame's bit errors leave of
`MOST_ERROR`), and the share of differing bits over it is the alignment's error.
The first offset whose stretch is long enough is the match. Of short recordings
the stretch is the whole overlap.

A number spans `HEARD` samples, and a run `SPAN`, so a shorter recording would be
silence for the most part, and unlike ones would agree in it. Recordings below
`SCALES`' bound are printed at a fine scale: frames and hops of a `FINE`-th, each
frame's spectrum still read at the same pitches. Those between both bounds are
printed at both scales, and numbers compare at one scale. At the fine scale a
recording meets only those of like length (`ALIKE`), the overlap is at least half of
the longer one, and its error at most `FINE_ERROR`; a passage that is short beside
its recordings is no match there. Candidates post fine runs at every `APART`-th
sample, queries all. At the scale of 1, recordings below `SHORT` get a number every
`STEP_SHORT` samples instead of every `HOP`, and compare with long ones. What is
below `SHORT`, or two fine runs, is laid between silences so far that each number
holds half of what one can. Places and offsets are counted in samples, overlaps in
numbers at the wider of the two steps. The error that is let pass shrinks with a
recording shorter than a number, as silences differ in no bit; at `LEAST_SOUND` of
it that stops. A run of silence alone is no run. A recording's count and hash of
numbers are those of its widest scale.

The partition of a common run is split by the session's adaptive skew join; its pairs
are then one row each, however many runs they share.

The job's query takes texts for recordings: the UTF-8 bytes of `documents.text`
as 8-bit samples, the one table of long byte strings with copies, near copies
and shared passages.

Defined results: a null or empty recording has no frames and matches nothing; a
short recording lies between silences; a null id
is no query; rows that share an id but not the sound are recordings of their
own; repeated rows share a class; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .hashing import mix

RATE, FRAME, HOP = 8000, 256, 64
LOW, HIGH = 100.0, 3500.0
WIDTH, BITS = 8, 32
STEP = 0.12
E = math.exp(STEP)
#: The length of a frame over its pitch classes.
ONE = 1 << 24
RUN, QUERY_EVERY = 4, 100
SHORT, STEP_SHORT = 1536, 16
LEAST_SOUND = 1 / 3
#: Samples of a number, and of a run.
HEARD = FRAME + HOP * (WIDTH - 1)
SPAN = HEARD + HOP * (RUN - 1)
#: Scale, and the sizes from and below which recordings are printed at it.
FINE = 16
SCALES = ((1, SPAN, 1 << 62), (FINE, 1, 1152))
#: Samples from one posted run of a fine candidate to the next, unless it is short even so.
APART = 16
LEAST_VOTES, MOST_ERROR, LEAST_OVERLAP = 2, 0.25, 8
#: At the fine scale: the most error, and how many times the shorter recording the longer may be.
FINE_ERROR, ALIKE = 0.2, 4 / 3
#: Numbers that are made at a time, and bytes of recordings that are taken together.
CHUNK, TOGETHER = 1 << 14, 1 << 20
#: A recording has as many phases at most.
PHASES = 64
#: Pairs of places that the histogram of offsets takes at a time.
PLACES = 1 << 20


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of each filter, by a rule that spreads them over the image."""
    out = []
    for i in range(BITS // 2):
        height, width = 2 + 2 * (i % 5), (2, 4, 6, 8)[i % 4]
        out.append((i % 4, (5 * i) % (12 - height + 1), height, width))
    return out


def _pitch_classes() -> tuple[np.ndarray, np.ndarray]:
    """The places of a spectrum that have a pitch class, class by class, and where each class begins."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    some = [(round(12 * math.log2(x / 440)) % 12, i) for i, x in enumerate(f) if LOW <= x <= HIGH]
    order = sorted(some)
    return np.array([i for _, i in order]), np.array([[c for c, _ in order].index(k) for k in range(12)])


(_PITCHED, _CLASSES), _WINDOWS = _pitch_classes(), {s: np.hanning(FRAME // s).astype(np.float32) for s, *_ in SCALES}


def chroma(frames: np.ndarray, scale: int = 1) -> np.ndarray:
    """Pitch classes by frames, each frame of length ONE (or 0 where it is silent); a frame is FRAME / scale samples.
    A frame's numbers do not depend on the frames that it is given with."""
    power = np.abs(np.fft.rfft(frames * _WINDOWS[scale], FRAME)[:, _PITCHED]).astype(np.float32)
    c = np.add.reduceat(np.log1p(power), _CLASSES, axis=1)
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return np.rint(c * (ONE / np.maximum(norm, np.float32(1e-9)))).astype(np.int32).T


def prints(image: np.ndarray, apart: int = 1) -> np.ndarray:
    """The 32-bit number of each frame from which the filters' width fits; a filter reads every `apart`-th frame.
    Whole numbers, of which only sums that fit are read, however long the image: so a number is the same wherever its frames lie."""
    size = image.shape[1]
    n = size - (WIDTH - 1) * apart
    rows = -(-size // apart)
    total = np.zeros((13, (rows + 1) * apart), np.int32)
    np.cumsum(image, axis=0, dtype=np.int32, out=total[1:, apart : apart + size])
    total = total.reshape(13, rows + 1, apart).cumsum(axis=1, dtype=np.int32).reshape(13, -1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        a, b = t0 * apart, t1 * apart
        return total[y1, b : b + n] - total[y1, a : a + n] - total[y0, b : b + n] + total[y0, a : a + n]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        if kind == 0:  # early against late
            a, b = area(0, w // 2, y, y + h), area(w // 2, w, y, y + h)
        elif kind == 1:  # low against high
            a, b = area(0, w, y, y + h // 2), area(0, w, y + h // 2, y + h)
        elif kind == 2:  # the diagonal quarters against the others
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            b = area(0, w // 2, y + h // 2, y + h) + area(w // 2, w, y, y + h // 2)
        else:  # the middle against the sides
            q = max(1, w // 4)
            b = area(q, w - q, y, y + h)
            a = area(0, w, y, y + h) - b
            a, b = a / (2 * q), b / max(1, w - 2 * q)
        a, b = a + float(ONE), b + float(ONE)  # their logarithms differ by more than -STEP, 0, STEP
        level = (a * E > b).astype(np.uint32) + (a > b) + (a > b * E)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # Gray code: neighbours differ by a bit
    return out


def samples_of(media: bytes, width: int) -> np.ndarray:
    if width == 1:
        return (np.frombuffer(media, np.uint8).astype(np.float32) - 128) / 128
    return np.frombuffer(media[: len(media) // 2 * 2], "<i2").astype(np.float32) / 32768


def scales_of(n: int) -> list[int]:
    """The scales of a recording of n samples, the widest first."""
    return [scale for scale, least, below in SCALES if least <= n < below]


def laid(samples: np.ndarray, scale: int = 1) -> tuple[int, int, np.ndarray]:
    """The place of the first number, the step between numbers, and the samples that they read, of a recording that is not empty."""
    n, heard, hop = len(samples), HEARD // scale, HOP // scale
    step = STEP_SHORT if scale == 1 and n < SHORT else hop
    start = 0
    if n < min(SHORT, 2 * SPAN // scale):  # between silences, and each number holds half of what one can
        start = (min(n, heard) // 2 - heard) // step * step
        samples = np.concatenate((np.zeros(-start, np.float32), samples, np.zeros(heard - min(n, heard) // 2, np.float32)))
    return start, step, samples


def numbers(many: list[np.ndarray], step: int, scale: int = 1) -> list[np.ndarray]:
    """The numbers of each of `many` recordings at a scale, `step` samples from one to the next. Frames of several are
    worked on at once, and a long recording's in parts, CHUNK or so at a time."""
    heard, frame, apart = HEARD // scale, FRAME // scale, HOP // scale // step
    lap = (WIDTH - 1) * apart
    out = [[] for _ in many]
    some, size = [], 0

    def work() -> None:
        starts, base = [], 0
        for _, part, n in some:
            starts.append(np.arange(base, base + (n + lap) * step, step))
            base += len(part)
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([part for _, part, _ in some]), frame)
        all_ = prints(chroma(windows[np.concatenate(starts)], scale), apart)
        at = 0
        for r, _, n in some:
            out[r].append(all_[at : at + n])
            at += n + lap
        some.clear()

    for r, samples in enumerate(many):
        count = (len(samples) - heard) // step + 1
        for i in range(0, count, CHUNK):
            n = min(CHUNK, count - i)
            if some and size + n + lap > CHUNK:
                work()
                size = 0
            some.append((r, samples[i * step : (i + n + lap - 1) * step + frame], n))
            size += n + lap
    if some:
        work()
    return [np.concatenate(x) for x in out]


def numbers_of(samples: np.ndarray, phase: int = 0, scale: int = 1) -> tuple[int, int, np.ndarray]:
    """The place of the first number, the step between numbers, and the numbers at a scale of a recording that is
    not empty, beginning `phase` samples late."""
    start, step, samples = laid(samples, scale)
    return start + phase, step, numbers([samples[phase:]], step, scale)[0]


def _hashes(media: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(media, digest_size=16).digest(), "<i8").tolist())


def phases(media: DataFrame, width: int = 1) -> DataFrame:
    """(s1, s2, size, scale, phase, p) of each recording (media) from each of its first samples up to a step."""
    names = ["s1", "s2", "phase", "scale", "start", "step", "size", "prints"]
    types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                data = x.as_py()
                data = data[: len(data) // width * width]
                samples = samples_of(data, width)
                rows = []
                for scale in scales_of(len(samples)):
                    start, step, all_ = laid(samples, scale)
                    p = numbers([all_], 1, scale)[0].astype("<u4")
                    rows += [(*_hashes(data), phase, scale, start + phase, step, len(samples), p[phase::step].tobytes()) for phase in range(step)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    made = media.select("media").mapInArrow(run, "s1 long, s2 long, phase int, scale int, start int, step int, size long, prints binary")
    return made.select("s1", "s2", "size", "scale", "phase", F.struct("scale", "start", "step", "size", "prints").alias("p"))


def fingerprints(recordings: DataFrame, width: int = 1) -> DataFrame:
    """(id, n, size, s1, s2, hash, scale, whole, start, step, prints) of `recordings` (id, media) at each of their scales, of
    which one is `whole`: `s1`, `s2` are a hash of the samples."""
    names = ["id", "n", "size", "s1", "s2", "hash", "scale", "whole", "start", "step", "prints"]
    types = [pa.int64()] * 6 + [pa.int32(), pa.bool_()] + [pa.int32()] * 2 + [pa.binary()]

    def made(some: list[tuple]) -> pa.RecordBatch:
        rows, alike = [], {}
        for i, media in some:
            samples, known = samples_of(media, width), _hashes(media)
            scales = scales_of(len(samples)) or [1]
            for scale in scales:
                start, step, all_ = laid(samples, scale) if len(samples) else (0, HOP, None)
                if all_ is not None:
                    alike.setdefault((step, scale), []).append((len(rows), all_))
                rows.append([i, 0, len(samples), *known, 0, scale, scale == scales[0], start, step, b""])
        for (step, scale), many in alike.items():
            for (k, _), p in zip(many, numbers([x for _, x in many], step, scale), strict=True):
                at = mix(p.astype(np.uint64) + (np.arange(len(p), dtype=np.uint64) << np.uint64(32)))
                rows[k][1], rows[k][5], rows[k][10] = len(p), int(at.sum(dtype=np.uint64).view(np.int64)), p.astype("<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, size = [], 0
            for i, x in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1), strict=True):
                media = x.as_py() or b""
                some.append((i, media[: len(media) // width * width]))
                size += len(media)
                if size >= TOGETHER:
                    yield made(some)
                    some, size = [], 0
            if some:
                yield made(some)

    return recordings.select("id", "media").mapInArrow(run, "id long, n long, size long, s1 long, s2 long, hash long, scale int, whole boolean, start int, step int, prints binary")


def runs_of(p: np.ndarray, apart: int = 1) -> np.ndarray:
    """A hash of each RUN numbers in a row, `apart` numbers from one to the next."""
    out = np.zeros(max(0, len(p) - (RUN - 1) * apart), np.uint64)
    for i in range(RUN if len(out) else 0):
        out = mix(out + p[i * apart : i * apart + len(out)])
    return out


#: The hash of a run of silence.
SILENT = runs_of(np.full(RUN, prints(np.zeros((12, WIDTH), np.int32))[0], np.uint32))[0]


def _posts(batches: Iterator[pa.RecordBatch], asked: bool = False) -> Iterator[pa.RecordBatch]:
    """Each distinct run of a recording (key, scale, start, step, size, prints) that is not silence alone, with `mark`: twice its first place,
    and one more if it stands there again; and `length`, the size of a fine recording, else 0. A run is known by its numbers, scale and, at the fine scale, length. Of fine candidates
    that are not short even so, those that stand at every `APART`-th sample; one that is `asked` has them under each length that it meets."""
    for batch in batches:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for key, scale, start, step, size, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = runs_of(np.frombuffer(p, "<u4"), HOP // scale // step)
            run, of, times = np.unique(runs, return_inverse=True, return_counts=True)
            every = max(1, APART // step) if not asked and scale > 1 and len(runs) * step > SPAN // 4 else 1
            some, first = np.unique(of[::every], return_index=True)
            run, mark = run[some], 2 * (start + step * every * first.astype(np.int64)) + (times[some] > 1)
            sound = run != SILENT
            run, mark = run[sound], mark[sound]
            # a fine recording meets those whose logarithm of length is one step from its own at most
            length = math.floor(math.log(size) / math.log(ALIKE)) if scale > 1 else 0
            for x in range(length - 1, length + 2) if asked and scale > 1 else [length]:
                columns[0].append(mix(run + mix(np.array([(scale << 16) + x], np.uint64))).view(np.int64))
                columns[1].append(np.full(len(run), key, np.int64))
                columns[2].append(mark)
                columns[3].append(np.full(len(run), size if scale > 1 else 0, np.int64))
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["run", "key", "mark", "length"])


def _asked_posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _posts(batches, True)


def offset_votes(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """The offsets (place in b less place in a) of shared runs, by most votes and least size, and their votes.
    a, b: scale, start, step and prints of a recording."""
    runs, places = [], []
    for x in (a, b):
        run = runs_of(np.frombuffer(x["prints"], "<u4"), HOP // x["scale"] // x["step"])
        order = np.argsort(run, kind="stable")
        order = order[run[order] != SILENT]
        runs.append(run[order])
        places.append(x["start"] + x["step"] * order)
    first, last = np.searchsorted(runs[1], runs[0]), np.searchsorted(runs[1], runs[0], side="right")
    n = last - first
    off, votes = np.empty(0, np.int64), np.empty(0, np.int64)
    upto = np.cumsum(n)
    at = 0
    while at < len(n):  # some places of a at a time, with all of b's that share their runs
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLACES, side="right")))
        k = n[at:to]
        mine = np.repeat(places[0][at:to], k)
        theirs = places[1][np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[at:to], k)]
        new, count = np.unique(theirs - mine, return_counts=True)
        both, where = np.unique(np.concatenate((off, new)), return_inverse=True)
        votes = np.bincount(where, np.concatenate((votes, count)), len(both)).astype(np.int64)
        off = both
        at = to
    order = np.lexsort((off, np.abs(off), -votes))
    return off[order], votes[order]


def aligned(a: dict, b: dict) -> tuple[int, int, int, int, int] | None:
    """(offset, votes, overlap, bit errors, start in a) of the match of two recordings, at one scale, each with scale, start, step, size and prints."""
    x, y = np.frombuffer(a["prints"], "<u4"), np.frombuffer(b["prints"], "<u4")
    wide = max(a["step"], b["step"])
    fine = a["scale"] > 1
    if fine and max(a["size"], b["size"]) > ALIKE * min(a["size"], b["size"]):
        return None
    most = (FINE_ERROR if fine else MOST_ERROR) * min(1.0, max(LEAST_SOUND, min(a["size"], b["size"]) * a["scale"] / HEARD))
    least = max(1.0, min(LEAST_OVERLAP * HOP, min(a["step"] * len(x), b["step"] * len(y)) // 2) / wide)
    least = max(least, max(len(x), len(y)) / 2) if fine else least
    whole = min(a["size"], b["size"]) < SHORT
    for off, votes in zip(*(z.tolist() for z in offset_votes(a, b)), strict=True):
        if votes < LEAST_VOTES:
            return None
        # places in a where both have a number: those of the recording with the wider step
        first = a["start"] if a["step"] == wide else b["start"] - off
        low, high = max(a["start"], b["start"] - off), min(a["start"] + a["step"] * (len(x) - 1), b["start"] - off + b["step"] * (len(y) - 1))
        at = np.arange(first + -(-(low - first) // wide) * wide, high + 1, wide)
        wrong = np.bitwise_count(x[(at - a["start"]) // a["step"]] ^ y[(at + off - b["start"]) // b["step"]]).astype(np.int64)
        i, j = 0, len(at)
        if not whole and j:
            total = np.concatenate(([0.0], np.cumsum(most * BITS - wrong)))
            lowest = np.minimum.accumulate(total[:-1])
            j = int(np.argmax(total[1:] - lowest)) + 1
            i = int(np.argmax(total[:j] == lowest[j - 1]))
        errors = int(wrong[i:j].sum())
        if j - i >= least and errors <= most * BITS * (j - i):
            return off, votes, j - i, errors, int(at[i])
    return None


MATCH = "q1 long, q2 long, c1 long, c2 long, query_id long, id long, offset int, votes long, overlap long, bit_errors long, place long"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 6 + [pa.int32()] + [pa.int64()] * 4
    for batch in batches:
        out = []
        for *ids, a, b in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            found = aligned(a, b)
            if found:
                out.append((*ids, *found))
        columns = list(zip(*out, strict=True)) if out else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in MATCH.split(", ")])


def search(recordings: DataFrame, width: int = 1, every_shift: bool = False) -> DataFrame:
    """One row per recording with its class, without a query, and one per class (by its least id) and
    query class that it matches. `recordings` has id and media. A class is known by its samples: classes
    may share their least id, and are searched apart."""
    found = materialize(fingerprints(recordings, width))
    key = ["size", "s1", "s2"]
    full = found.where("n > 0 and id is not null")
    asks = F.pmod("id", F.lit(QUERY_EVERY)) == 0
    # equal samples have equal numbers: any row's stand for the class
    classes = full.groupBy(*key).agg(F.min("id").alias("class_id"), F.max(asks).alias("asks"))
    first = full.join(classes, key).where("id = class_id").dropDuplicates([*key, "scale"])
    # a number for each class and scale; with a phase it takes PHASE times as many
    leads = materialize(first.select(F.monotonically_increasing_id().alias("key"), *key, "scale", "class_id", "asks", F.struct("scale", "start", "step", "size", "prints").alias("p")))
    asked = leads.where("asks").withColumn("phase", F.lit(0))
    if every_shift:  # few bytes, much work: as many tasks as the input has
        few = recordings.where(asks & F.col("media").isNotNull()).select("media").repartition(max(1, recordings.rdd.getNumPartitions()), "media").distinct()
        asked = materialize(leads.where("asks").drop("p").join(phases(few, width), [*key, "scale"]))
    asked = asked.select((F.col("key") * PHASES + F.col("phase")).alias("q"), F.col("s1").alias("q1"), F.col("s2").alias("q2"), F.col("class_id").alias("q_id"), F.col("p").alias("qp"))
    others = leads.select(F.col("key").alias("c"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("class_id").alias("c_id"), F.col("p").alias("cp"))

    def runs(df: DataFrame, key: str, p: str, posted) -> DataFrame:
        kept = df.select(key, f"{p}.scale", f"{p}.start", f"{p}.step", f"{p}.size", f"{p}.prints")
        return kept.mapInArrow(posted, "run long, key long, mark long, length long").withColumnsRenamed({"key": key, "mark": f"{key}_mark", "length": f"{key}_length"})

    # Two votes for one offset: two runs that stand once in each recording and lie equally far apart, or, where a run stands
    # again on a side and may vote for any offset, a second shared run or the same one again on the other side.
    again = F.col("c_mark").bitwiseAND(1) + F.col("q_mark").bitwiseAND(1)
    # What `aligned` asks of fine recordings before all else. An offset's overlap tells nothing yet: the pair may match at one whose runs are not posted
    fits = F.greatest("c_length", "q_length") <= ALIKE * F.least("c_length", "q_length")
    shared = runs(others, "c", "cp", _posts).join(runs(asked, "q", "qp", _asked_posts), "run").where(F.expr(f"q div {PHASES} <> c") & fits)
    votes = shared.groupBy("q", "c", F.when(again == 0, F.col("c_mark") - F.col("q_mark")).alias("off")).agg(F.count(F.lit(1)).alias("n"), F.max(again == 2).alias("both"))
    best = votes.groupBy("q", "c").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.max(F.col("off").isNull()).alias("free"), F.max("both").alias("both"))
    pairs = best.where((F.col("most") >= LEAST_VOTES) | F.col("free") & (F.col("all") >= LEAST_VOTES) | F.col("both")).select("q", "c")
    both = pairs.join(asked, "q").join(others, "c")
    each = both.select("q1", "q2", "c1", "c2", "q_id", "c_id", "qp", "cp").mapInArrow(_aligned, MATCH)
    best = F.max_by(F.struct("query_id", "id", "offset", "votes", "overlap", "bit_errors", "place"), F.struct("votes", "overlap", -F.col("bit_errors"), -F.col("offset")))
    matches = each.groupBy("q1", "q2", "c1", "c2").agg(best.alias("m")).select("m.*").withColumn("bit_error_rate", F.col("bit_errors") / (F.col("overlap") * BITS))
    members = found.where("whole").select("id", "n", "hash", *key).join(classes.drop("asks"), key, "left")
    members = members.select("id", F.coalesce("class_id", "id").alias("class_id"), F.col("n").alias("n_prints"), F.col("hash").alias("prints_hash"))
    return members.unionByName(matches.withColumn("class_id", F.col("id")), allowMissingColumns=True)
