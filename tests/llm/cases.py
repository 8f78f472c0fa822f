"""Small documents with the cases that every operator must stand: nulls, empty and long texts, ties, repeats."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, kept string, _n int, "
          "rank string")


def rows(pairs, source=lambda i: f"s{i % 3}"):
    """Rows with extra columns whose names the operators use themselves."""
    return [(i, t, "en", source(k), None, "x", "y", 9, "z") for k, (i, t) in enumerate(pairs)]


def corpus(seed=5, n=40):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma,", "delta", "été", "x1", "The", "of.", "in", "日本", "end"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 13, 40, 120]))) for _ in range(n)]
    passage = " ".join(f"shared{i}" for i in range(30))
    pairs = [(i, t) for i, t in enumerate(base)]
    pairs += [(100 + i, base[i] + " tail") for i in range(0, n, 3)]
    pairs += [(200 + i, base[i].replace(" ", "\n ")) for i in range(0, n, 4)]
    pairs += [(300 + i, f"{base[i]} {passage} {base[(i + 1) % n]}") for i in range(0, n, 5)]
    pairs += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "One"), (405, "a\x0bb\x0cc d e f g"),
              (406, "word " * 20000), (407, "no-break\u00a0space here"), (None, base[0]), (None, None),
              (3, base[3]), (3, base[3]), (450, base[7] + " é"), (451, "𝒳 emoji 😀 " * 5)]
    rng.shuffle(pairs)
    return pairs
