"""MinHash sketches and similarity scores as column functions."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Fixed values ---------------------------------------------------------------
NUM_PERM = 128
SEED = 12
MERSENNE_PRIME = (1 << 61) - 1
MAX_HASH = (1 << 32) - 1
# Bands and rows of the index at threshold 0.7, weights 0.8 / 0.2, 128 values.
BANDS = 10
ROWS = 12
# The same trade-off at other thresholds.
BANDS_ROWS = {
    0.3: (32, 4), 0.5: (18, 7), 0.6: (14, 9), 0.7: (10, 12), 0.8: (7, 18), 0.9: (4, 32),
}
# ----------------------------------------------------------------------------


@functools.lru_cache(maxsize=16)
def permutations(num_perm: int = NUM_PERM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients a, b of the hash permutations, drawn pairwise from a seeded MT19937."""
    rng = np.random.RandomState(seed)
    pairs = [
        (
            rng.randint(1, MERSENNE_PRIME, dtype=np.uint64),
            rng.randint(0, MERSENNE_PRIME, dtype=np.uint64),
        )
        for _ in range(num_perm)
    ]
    a, b = np.array(pairs, dtype=np.uint64).T
    return np.ascontiguousarray(a), np.ascontiguousarray(b)


def item_word(item: Column) -> Column:
    """Hash of a string: its first four SHA-1 bytes, read as a little-endian number."""
    return F.unhex(F.substring(F.sha1(item), 1, 8))


def read_words(column: pa.Array) -> np.ndarray:
    """Numbers of an Arrow column of :func:`item_word` values without nulls."""
    if not len(column):
        return np.empty(0, dtype=np.uint32)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, dtype=np.int32)[column.offset]
    return np.frombuffer(data, dtype="<u4", count=len(column), offset=first)


CHUNK = 1 << 14  # words per pass, so that the passes stay in cache


def _permute(words: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """((a * word + b) mod 2^64) mod p, low 32 bits.

    p is 2^61 - 1, so mod p is a shift and an add, and taking p off once more
    adds one to the low bits.
    """
    v = words * a
    v += b
    v = (v & np.uint64(MERSENNE_PRIME)) + (v >> np.uint64(61))
    v += (v + np.uint64(1)) >> np.uint64(61)
    v &= np.uint64(MAX_HASH)
    return v


def min_hashes(words: np.ndarray, offsets: np.ndarray, num_perm: int, seed: int) -> np.ndarray:
    """Signatures (rows x num_perm) of the slices of ``words`` that ``offsets`` marks."""
    sig = np.full((len(offsets) - 1, num_perm), MAX_HASH, dtype=np.int64)
    filled = np.flatnonzero(np.diff(offsets))
    starts = offsets[:-1][filled]
    total = int(offsets[-1])
    coefficients = list(zip(*permutations(num_perm, seed)))
    for low in range(0, total, CHUNK):
        high = min(low + CHUNK, total)
        chunk = words[low:high].astype(np.uint64)
        first = np.searchsorted(starts, low, "right") - 1
        last = np.searchsorted(starts, high, "left")
        cuts = np.maximum(starts[first:last], low) - low
        found = np.stack(
            [np.minimum.reduceat(_permute(chunk, a, b), cuts) for a, b in coefficients], axis=1
        )
        rows = filled[first:last]
        sig[rows] = np.minimum(sig[rows], found.astype(np.int64))
    return sig


def _list_column(values: np.ndarray, mask) -> pa.Array:
    rows, width = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()), mask=mask)


def minhash(items: Column, num_perm: int = NUM_PERM, seed: int = SEED) -> Column:
    """MinHash of an array of strings; an empty array gives the all-maximum signature."""

    def sign(batch: pa.Array) -> pa.Array:
        offsets = np.concatenate(
            [[0], np.cumsum(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        ).astype(np.int64)
        sig = min_hashes(read_words(batch.flatten()), offsets, num_perm, seed)
        return _list_column(sig, batch.is_null())

    sign.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    words = F.transform(F.array_compact(items), item_word)
    return F.arrow_udf(sign, "array<bigint>")(words)


@functools.lru_cache(maxsize=1 << 15)
def cws_parameters(dim: int, num_samples: int, seed: int) -> np.ndarray:
    """r, ln c, beta of consistent weighted sampling for one dimension (3 x num_samples).

    r and c are Gamma(2,1) draws, i.e. -ln of a product of two uniforms; the
    five uniforms come from the five words of SHA-1("seed:dim:sample").
    """
    words = np.frombuffer(
        b"".join(
            hashlib.sha1(f"{seed}:{dim}:{i}".encode()).digest() for i in range(num_samples)
        ),
        dtype=">u4",
    ).reshape(num_samples, 5)
    u = (words.astype(np.float64) + 0.5) / 4294967296.0
    r = -np.log(u[:, 0] * u[:, 1])
    ln_c = np.log(-np.log(u[:, 2] * u[:, 3]))
    return np.stack([r, ln_c, u[:, 4]])


def weighted_minhash(vec: Column, num_samples: int = NUM_PERM, seed: int = SEED) -> Column:
    """Consistent weighted samples of a map from dimension to weight.

    An array of (dim, t) structs, one per sample; null for a vector without
    positive weights. Two vectors agree on a sample with the probability of
    their weighted Jaccard similarity.
    """

    def sample(dims: pa.Array, weights: pa.Array) -> pa.Array:
        sizes = dims.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat_dims = dims.flatten().to_numpy(zero_copy_only=False)
        flat_weights = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = sizes.astype(np.int64)
        filled = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[filled])
        starts = ends - sizes[filled]
        distinct, which = np.unique(flat_dims, return_inverse=True)
        drawn = [cws_parameters(int(k), num_samples, seed) for k in distinct]
        drawn = np.stack(drawn) if drawn else np.empty((0, 3, num_samples))
        keys, steps = np.empty((len(filled), num_samples)), np.empty((len(filled), num_samples))
        first = 0
        while first < len(filled):
            # rows that together have about 32 CHUNK pairs of weight and sample
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + max(1, 32 * CHUNK // num_samples), "right")))
            low, high = starts[first], ends[last - 1]
            r, ln_c, beta = drawn[which[low:high]].transpose(1, 0, 2)
            t = np.floor(np.log(flat_weights[low:high])[:, None] / r + beta)
            value = ln_c - r * (t - beta) - r
            cuts = starts[first:last] - low
            least = np.repeat(np.minimum.reduceat(value, cuts, axis=0), sizes[filled[first:last]], axis=0)
            place = np.where(value == least, np.arange(high - low)[:, None], high - low)
            best = np.minimum.reduceat(place, cuts, axis=0)
            keys[first:last] = flat_dims[low:high][best]
            steps[first:last] = np.take_along_axis(t, best, axis=0)
            first = last
        empty = sizes == 0
        offsets = np.concatenate([[0], np.cumsum(~empty) * num_samples])
        keys, steps = keys.ravel(), steps.ravel()
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(steps.astype(np.int64))],
                ["dim", "t"],
            ),
            mask=pa.array(empty, pa.bool_()),
        )

    sample.__annotations__ = {"dims": pa.Array, "weights": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(sample, "array<struct<dim: bigint, t: bigint>>")
    entries = F.array_sort(F.map_entries(F.map_filter(vec, lambda _, w: w > 0)))
    return udf(
        F.transform(entries, lambda e: e["key"].cast("bigint")),
        F.transform(entries, lambda e: e["value"].cast("double")),
    )


def band_hashes(sig: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One 60-bit key per band of ``rows`` signature values."""
    def key(i: int) -> Column:
        text = F.array_join(F.slice(sig, i * rows + 1, rows).cast("array<string>"), ",")
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

    return F.array(*[key(i) for i in range(bands)])


def shares_band(a: Column, b: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """True when two signatures are equal over at least one whole band."""
    equal = F.lit(False)
    for i in range(bands):
        equal = equal | (F.slice(a, i * rows + 1, rows) == F.slice(b, i * rows + 1, rows))
    return equal


def jaccard_est(a: Column, b: Column) -> Column:
    """Share of equal signature positions."""
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x
    )
    return same / F.size(a)


def jaccard_exact(a: Column, b: Column) -> Column:
    """Jaccard of two sets given as arrays without duplicates; null for two empty sets."""
    common = F.size(F.array_intersect(a, b))
    return F.try_divide(common, F.size(a) + F.size(b) - common)


def vector_id(vec: Column) -> Column:
    """Identity of a count map: equal maps share it, whatever the order of their entries."""
    return F.coalesce(F.md5(F.to_json(F.array_sort(F.map_entries(vec)))), F.lit(""))


def square_sum(vec: Column) -> Column:
    """Squared Euclidean length of a count map."""
    return F.aggregate(F.map_values(vec), F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def cosine_distance(a: Column, b: Column, squares_a: Column | None = None,
                    squares_b: Column | None = None) -> Column:
    """1 - cosine of two count maps; NaN when one is all zero.

    ``squares_*`` pass squared lengths that are already known.
    """
    products = F.map_zip_with(
        a, b, lambda _, x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))
    )
    dot = F.aggregate(F.map_values(products), F.lit(0.0), lambda s, x: s + x)
    squares_a = square_sum(a) if squares_a is None else squares_a
    squares_b = square_sum(b) if squares_b is None else squares_b
    lengths = F.sqrt(squares_a * squares_b)
    return F.when(lengths == 0, F.lit(float("nan"))).otherwise(
        F.greatest(F.lit(0.0), 1 - dot / lengths)
    )


def dense_cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two equally long arrays of numbers."""
    def dot(x: Column, y: Column) -> Column:
        terms = F.zip_with(x, y, lambda p, q: p.cast("double") * q)
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    lengths = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(lengths == 0, F.lit(float("nan"))).otherwise(
        F.greatest(F.lit(0.0), 1 - dot(a, b) / lengths)
    )
