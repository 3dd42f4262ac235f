import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, k long, h long, line string"


def frame(spark, texts, langs=None, sources=None, ids=None):
    """Documents with further columns whose names clash with working ones."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "a", len(t or ""), 0.5, 1, 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def texts():
    """Texts of every awkward kind, with copies, near copies and repeated passages."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9))) for _ in range(900)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [make(rnd.randint(1, 300)) for _ in range(60)]
    shared = make(60)
    out += [f"{make(40)} {shared} {make(30)}" for _ in range(5)]
    out += [out[0], out[0], out[3] + " more", "\n".join(out[5:8]), None, "", "  \n\t ", "one", "one two three four"]
    near = out[10].split()
    for i in range(6):
        w = list(near)
        w[(i * 7) % len(w)] = "changed"
        out.append(" ".join(w))
    out.append("say it again " * 60)
    out.append(make(4000))
    return out
