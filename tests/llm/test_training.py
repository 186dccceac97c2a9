"""Training steps of the two networks, against loops over single numbers and finite differences; hot leaders; a text of 3 MB."""

import numpy as np

from barline.llm import language_id, language_model, quality


def test_quality_step_is_the_gradient_of_the_loss():
    """One AdaGrad step on a batch of all documents, by finite differences of the mean cross entropy."""
    g = np.random.default_rng(2)
    bags = []
    for _ in range(7):
        ids = np.sort(g.choice(40, 9, replace=False)).astype(np.int32)
        share = g.random(9).astype(np.float32)
        bags.append((ids, share / share.sum()))
    target = np.array([0, 1, 1, 0, 1, 0, 1.0])
    before, after = (quality.train(bags, target, epochs=n, batch=7, rate=0.1) for n in (0, 1))

    def loss(vectors, out, bias):
        total = 0.0
        for (ids, share), label in zip(bags, target, strict=True):
            z = [bias[c] + sum(s * vectors[i][d] * out[d][c] for i, s in zip(ids, share, strict=True) for d in range(quality.DIMS)) for c in (0, 1)]
            total -= z[int(label)] - np.log(sum(np.exp(z)))
        return total / len(bags)

    start = [np.array(p[:40] if k == 0 else p, np.float64) for k, p in enumerate((before.vectors, before.out, before.bias))]
    for which, got in enumerate((after.vectors[:40], after.out, after.bias)):
        for place in list(np.ndindex(start[which].shape))[:: 11 if which == 0 else 1]:
            sides = []
            for h in (1e-5, -1e-5):
                moved = [p.copy() for p in start]
                moved[which][place] += h
                sides.append(loss(*moved))
            grad = (sides[0] - sides[1]) / 2e-5
            assert np.isclose(got[place], start[which][place] - 0.1 * grad / np.sqrt(1e-4 + grad * grad), atol=2e-5), (which, place)
    assert (after.vectors[40:] == before.vectors[40:]).all()


def plain_gradients(net, x, target):
    """Gradients of the mean cross entropy, one window, filter and byte at a time."""
    got = [np.zeros_like(p) for p in (net.embed, *net.kernels, *net.biases, net.out, net.bias)]
    for row, label in zip(x, target, strict=True):
        top, where = [], []
        for kernel, bias in zip(net.kernels, net.biases, strict=True):
            for f in range(language_id.FILTERS):
                acts = [sum(float(net.embed[row[p + k]] @ kernel[k, :, f]) for k in range(len(kernel))) for p in range(len(row) - len(kernel) + 1)]
                where.append(int(np.argmax(acts)))
                top.append(max(max(acts) + bias[f], 0.0))
        z = np.array(top) @ net.out + net.bias
        d = np.exp(z) / np.exp(z).sum()
        d[label] -= 1
        d /= len(x)
        got[-1] += d
        for j, t in enumerate(top):
            got[-2][j] += t * d
            back = float(net.out[j] @ d) if t > 0 else 0.0
            i, f = divmod(j, language_id.FILTERS)
            got[1 + len(net.kernels) + i][f] += back
            for k in range(len(net.kernels[i])):
                byte = row[where[j] + k]
                got[1 + i][k, :, f] += back * net.embed[byte]
                got[0][byte] += back * net.kernels[i][k, :, f]
    return got


def test_network_steps_against_a_slow_loop():
    """Three Adam steps on all windows; the loop's own gradients are held against finite differences."""
    g = np.random.default_rng(4)
    x, target, labels = g.integers(97, 123, (6, 14)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2]), ["a", "b", "c"]
    slow = language_id.train(x, target, labels, epochs=0)
    params = [slow.embed, *slow.kernels, *slow.biases, slow.out, slow.bias]

    def loss():
        return -slow.log_probs(slow.pooled(x)[0])[np.arange(6), target].mean()

    for p, grad in zip(params, plain_gradients(slow, x, target), strict=True):
        place = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, sides = p[place], []
        for h in (1e-3, -1e-3):  # the tables are of single precision
            p[place] = kept + h
            sides.append(loss())
        p[place] = kept
        assert np.isclose((sides[0] - sides[1]) / 2e-3, grad[place], rtol=0.02, atol=1e-4)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in (1, 2, 3):
        for p, m, v, grad in zip(params, first, second, plain_gradients(slow, x, target), strict=True):
            m[...] = 0.9 * m + 0.1 * grad
            v[...] = 0.999 * v + 0.001 * grad**2
            p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    fast = language_id.train(x, target, labels, epochs=3)
    for mine, theirs in zip(params, (fast.embed, *fast.kernels, *fast.biases, fast.out, fast.bias), strict=True):
        assert np.allclose(mine, theirs, atol=1e-4)


def test_language_model_places_and_shares():
    """The dictionary's index finds what a sorted search finds; products of powers are the softmax of the added logits, and large weights are added."""
    rng = np.random.default_rng(3)
    for h in (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64) + np.uint64(1 << 62), np.array([0, 2**64 - 1], np.uint64)):
        h = np.unique(h)
        v = language_model.Vocabulary(h, np.arange(len(h)) + 1, np.arange(len(h)), 1, 1, 0.1)
        asked = np.concatenate([h, h + np.uint64(1), h - np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        place = np.minimum(np.searchsorted(h, asked), len(h) - 1)
        want = np.where(h[place] == asked, place, -1)
        assert (v.look(asked)[1] == want).all() and (v.look(asked)[0] == np.where(want < 0, -1, want + 1)).all()
    rows, node, at = [rng.integers(0, 50, 300), rng.integers(50, 100, 300)], rng.integers(0, 7, 300), rng.integers(0, 64, 300)
    for scale, safe in ((1.0, True), (30.0, False)):
        table, bias = (rng.normal(0, scale, (n, 64)).astype(np.float32) for n in (100, 7))
        shares = language_model.Shares(table, bias, 2)
        z = table[rows[0]].astype(float) + table[rows[1]] + bias[node]
        z -= z.max(1, keepdims=True)
        want = z[np.arange(300), at] - np.log(np.exp(z).sum(1))
        assert bool(shares.safe) == safe
        assert np.abs(shares.log(rows, node, at) - want).max() < 1e-4
