"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, row string, kept string, score double, spans string, label string, part string, words string"
N_EXTRA = 9


def documents(spark, rows, partitions=3):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or ""), *(None,) * 2, *("x",) * 2, 0.5, *("x",) * 4) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def prose(seed, n, words=None):
    rng = random.Random(seed)
    vocab = words or [a + b + c for a in ("th", "er", "on", "an", "re") for b in ("e", "a", "i") for c in ("nd", "st", "ing", "s", "")]
    return [rng.choice(vocab) for _ in range(n)]


def corpus(seed=1):
    """(doc_id, text): prose with exact copies, near copies, shared passages, repeats within a text, blank and null texts."""
    rng, out = random.Random(seed), []
    passage = " ".join(prose(99, 60))
    for k in range(40):
        out.append((k, " ".join(prose(k, rng.randint(1, 120)))))
    for k in range(40, 60):  # near copies of a few texts
        ws = out[k % 5][1].split()
        ws[rng.randrange(len(ws))] = f"edit{k}"
        out.append((k, " ".join(ws)))
    out += [(k, out[k % 7][1]) for k in range(60, 70)]
    out += [(k, " ".join(prose(k, 30)) + "  " + passage + "\n" + " ".join(prose(k + 500, 10))) for k in range(70, 76)]
    out += [
        (76, passage + " " + passage), (77, None), (78, ""), (79, " \t\n"), (80, "one"), (81, "One"), (82, "one two three"), (83, "ONE TWO THREE"),
        (84, "é " * 30), (85, " ".join(prose(5, 30_000)))
    ]
    return out


class Union(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)
