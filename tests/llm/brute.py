"""The scores and classes of operators 5, 8 and 10 by plain loops, text by text."""

import collections
import math

import regex
import xxhash

M = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


def mix(x):
    x &= M
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def text_hash(text):
    if len(text) > 32:
        return xxhash.xxh3_64_intdigest(text.encode("utf-32-le", "surrogatepass"))
    return mix(sum(mix((ord(c) + 1) * STEP) * pow(STEP, i, 1 << 64) for i, c in enumerate(text)) + len(text))


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def words_of(text):
    return [w for w in regex.split(r"\s+", text) if w]


# Operator 5


def toxic_score(model, text):
    means = []
    for w in words_of(text.lower()):
        b = f"<{w}>"
        grams = [b] + [b[i : i + n] for n in (3, 4, 5) if len(b) > n for i in range(len(b) - n + 1)]
        means.append(sum(float(model.gain[text_hash(g) >> 47]) for g in grams) / len(grams))
    starts = [0] if len(means) <= 8 else [min(a, len(means) - 8) for a in range(0, len(means) - 8 + 4, 4)]
    largest = max(sum(means[a : a + 8]) / len(means[a : a + 8]) for a in starts) if means else 0.0
    return sigmoid(model.scale * largest + model.shift)


# Operator 10


def kind_of(c):
    return "letter" if regex.match(r"\p{L}", c) else "number" if regex.match(r"\p{N}", c) else "space" if regex.match(r"\s", c) else "other"


def runs_of(words, size):
    return [tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []


def seen_before(runs):
    seen, out = set(), []
    for r in runs:
        out.append(r in seen)
        seen.add(r)
    return out


def votes(text, labellers):
    """0 good, 1 none, 2 bad, in the order of labellers."""
    words, kinds = words_of(text), [kind_of(c) for c in text]
    n, solid, runs = max(len(words), 1), max(sum(k != "space" for k in kinds), 1), runs_of(words, 3)
    value = {
        "upper_share": sum("A" <= c <= "Z" for c in text) / max(kinds.count("letter"), 1), "odd_share": sum(k == "other" and c not in ".,;:'\"?!()-" for c, k in zip(text, kinds, strict=True)) / solid, "shout_rate": text.count("!") / n, "bar_rate": text.count("|") / n,
        "trailing_marks": sum(len(w) > 1 and kind_of(w[-1]) == "other" and w[-1] not in ".,;:'\"?)" for w in words) / n, "repeat_share": sum(seen_before(runs)) / max(len(runs), 1), "stutter": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "word_length": solid / n, "sentence_words": len(words) / max(sum(text.count(c) for c in ".!?"), 1), "brevity": 1 / n,
    }
    return tuple(0 if value[k] <= low else 2 if value[k] >= high else 1 for k, (low, high) in labellers.items())


def posterior(all_votes, rounds=100):
    """The probability that texts of some votes are good, as a function, by expectation-maximisation over all texts."""
    count = collections.Counter(all_votes)
    good = {v: 0.15 if 2 in v else 0.95 for v in count}
    for _ in range(rounds):
        table = []
        for k, prior in enumerate(((8, 1.5, 0.5), (3, 1.5, 5.5))):
            weight = {v: n * (good[v] if k == 0 else 1 - good[v]) for v, n in count.items()}
            rows = [[prior[x] + sum(w for v, w in weight.items() if v[j] == x) for x in range(3)] for j in range(len(next(iter(count))))]
            table.append([[x / sum(r) for x in r] for r in rows])
        share = min((sum(n * good[v] for v, n in count.items()) + 9) / (sum(count.values()) + 10), 0.999)

        def chance(v, table=table, share=share):
            log = [sum(math.log(table[k][j][x]) for j, x in enumerate(v)) for k in (0, 1)]
            return sigmoid(log[0] + math.log(share) - log[1] - math.log(1 - share))

        new = {v: chance(v) for v in count}
        if max(abs(new[v] - good[v]) for v in count) < 1e-6:
            break
        good = new
    return chance


def shape_of(word):
    out = []
    for c in word:
        k = kind_of(c)
        s = ("\x01" if "A" <= c <= "Z" else "\x02") if k == "letter" else c if k == "other" else "\x02"
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def quality_score(scorer, text):
    words = words_of(text)
    shapes = [text_hash(shape_of(w)) for w in words]
    hashes = shapes + [mix(a * STEP + b) for a, b in zip(shapes, shapes[1:], strict=False)] + [int(x) + 7 for x in seen_before(runs_of(words, 3))]
    return sigmoid(sum(float(scorer.weight[mix(h) >> 50]) for h in hashes) / max(len(words), 1) + scorer.bias)


# Operator 8


def bag(text):
    return collections.Counter(runs_of(words_of(text.lower()), 5))


def similarity(a, b):
    common, union = sum((a & b).values()), sum((a | b).values())
    return common / union if union else 1.0


def classes(rows, threshold=0.8):
    """The least id of each id's class, for (id, text): all pairs of different texts are compared."""
    different = list({t: None for _, t in rows})
    bags = [bag(t) for t in different]
    label = list(range(len(different)))
    for i in range(len(different)):
        for j in range(i):
            a, b = sum(bags[i].values()), sum(bags[j].values())
            if min(a, b) >= threshold * max(a, b) and label[i] != label[j] and similarity(bags[i], bags[j]) >= threshold:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    of = dict(zip(different, label, strict=True))
    least = {}
    for d, t in rows:
        least[of[t]] = min(least.get(of[t], d), d)
    return {d: least[of[t]] for d, t in rows}
