"""What the training on all tokens computes only once, against the plain way."""

import numpy as np
import pyarrow as pa

from lumenscreen.llm.secrets import AROUND, INSIDE, WIDTH, CharCNN, Quick, Sums, Surroundings, elsewhere_in, find_base, flat
from lumenscreen.llm.text import slices


def windows(sizes):
    rng = np.random.default_rng(4)
    x = rng.integers(1, 128, (len(sizes), WIDTH)).astype(np.uint8)
    x[:, AROUND : AROUND + INSIDE] *= np.arange(INSIDE) < np.array(sizes)[:, None]
    return x


class Counted(Quick):
    places = 0

    def _filters(self, x):
        self.places += len(x) * (x.shape[1] - self.width + 1)
        return super()._filters(x)


def test_padding_is_not_computed():
    # A token of 8 bytes has 16 + 8 places that start before its end, 16 behind the padding and one of zeros only.
    quick = Counted(CharCNN(3))
    quick.sums(windows([8] * 500), 0)
    assert quick.places <= 500 * 41
    quick.places = 0
    quick.logits(windows([8] * 500))
    assert quick.places <= 500 * 41


def test_moved_tokens_look_their_surroundings_up():
    x, plain = windows([8] * 500), windows([9] * 20)
    quick = Counted(CharCNN(3))
    around = Surroundings(quick, plain)
    quick.places = 0
    Sums(quick, 0, around).add(x, np.arange(500) % 20)
    assert quick.places <= 500 * 13


def plain_sums(model, x, label):
    """Loss and gradient of the tables' bytes, place by place."""
    quick = Quick(model)
    h = quick._filters(x)
    top = h.max(1)
    z = np.maximum(top, 0).astype(np.float64) @ model.p["w"] + model.p["c"][0]
    sign = 1 - 2 * label
    dz = sign / (1 + np.exp(-sign * z))
    tables = np.zeros((quick.width, 128, quick.filters))
    for r, c in np.argwhere(top > 0):
        at = h[r, :, c].argmax()
        for j in range(quick.width):
            tables[j, x[r, at + j], c] += dz[r] * model.p["w"][c]
    k = model.p["k"].reshape(quick.width, -1, quick.filters)
    g = {"e": sum(t @ a.T for t, a in zip(tables, k, strict=True)), "k": model.p["e"].T @ tables, "b": tables[0].sum(0), "w": np.maximum(top, 0).T @ dz, "c": np.array([dz.sum()])}
    return z, np.concatenate([[np.logaddexp(0, sign * z).sum(), len(x)], *(g[name].ravel() for name in model.p)])


def test_sums_and_scores_equal_the_plain_way():
    sizes = [1, 2, 8, 8, 9, 20, 42, 43, 44, 45, 47, 48] * 30
    x, plain, model = windows(sizes), windows(range(1, 49)), CharCNN(5)
    x[::7, :AROUND] = 0  # at a document's start
    x[::11, -9:] = 0  # at its end
    which = np.random.default_rng(6).integers(0, len(plain), len(x))
    quick = Quick(model)
    around = Surroundings(quick, plain)
    moved = elsewhere_in(x, plain[which])
    for label in (0, 1):
        (own_z, own), (moved_z, other) = plain_sums(model, x, label), plain_sums(model, moved, label)
        assert np.allclose(quick.logits(x), own_z) and np.allclose(quick.logits(x, around, which), moved_z)
        assert np.allclose(quick.sums(x, label), own)
        both = Sums(quick, label, around)
        both.add(x[:100])
        both.add(x[:200], which[:200])
        both.add(x[100:])
        both.add(x[200:], which[200:])
        both.add(x[:0], which[:0])
        assert np.allclose(both.total(), own + other) and len(own) == len(flat(model)) + 2


def test_keys_that_straddle_documents_are_not_found():
    texts = ["sec", "ret=12345678 ", "token=abcdefgh token=ijklmnop", "AKI", "A" * 20, None, "AKIA" + "Z" * 12, "to", "ken: abcdefgh", "API_KEY=abcdefgh"]
    (part,) = slices(iter([pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})]))
    got = [[(s - int(a), e - int(a), k) for s, e, k in own] for own, a in zip(find_base(part), part.start, strict=True)]
    assert got == [[], [], [(0, 14, 0), (15, 29, 0)], [], [], [], [(0, 16, 1)], [], [], [(0, 16, 0)]]
