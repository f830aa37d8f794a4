"""Small documents with what operators must stand: nulls, blanks, copies, repeats."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(45))
    texts = []
    for i in range(n):
        body = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 80, 200]))]
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
            continue
        if kind < 0.4 and texts:
            body = words(rng.choice(texts))
            for _ in range(rng.randint(1, 3)):
                if body:
                    body[rng.randrange(len(body))] = rng.choice(vocab)
        if kind > 0.8:
            body[rng.randrange(len(body) + 1) : 0] = passage.split()
        sep = rng.choice([" ", "\n", "  ", "\t"])
        texts.append(sep.join(w.upper() if rng.random() < 0.05 else w for w in body))
    texts += [None, "", "   \n", "é ü ß", "one two three", "One TWO three", passage, passage + " " + passage]
    rng.shuffle(texts)
    return [(i * 3 % 101 + (1000 if i % 7 == 0 else 0), t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "Z", "ä", None]), len(t or "")) for i, t in enumerate(texts)]
