import random

import pytest

SCHEMA = ("doc_id long, text string, source string, lang string, n_words long, kept boolean, id long, bucket long, fp long, "
          "term string, size long, target double, key string, anchor long, word string, w array<string>, item string")
EXTRA = (1, True, 2, 3, 4, "t", 5, 6.0, "k", 7, "x", ["w"], "i")


def make(spark, rows):
    """Documents with every extra column whose name an operator might use itself."""
    return spark.createDataFrame([(*r, "s", "en")[:4] + EXTRA if len(r) < 4 else tuple(r) + EXTRA for r in rows], SCHEMA)


def prose(seed, n):
    """n words of invented prose."""
    r = random.Random(seed)
    return " ".join(r.choice("the of and river stone light moves over old quiet house near green field ".split())
                    + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source, lang): copies, near copies, a shared passage, nulls, blanks, short and very long texts."""
    base, passage = prose(1, 120).split(), prose(2, 60)
    near = base[:]
    near[60] = "changed"
    rows = [(1, " ".join(base), "a", "en"), (2, " ".join(base), "a", "en"), (3, " ".join(near), "b", "en"),
            (4, prose(3, 50) + "\n" + passage + " " + prose(4, 30), "b", "fr"), (5, passage + "\n" + prose(5, 20), None, None),
            (6, None, "a", "en"), (7, "", "b", "en"), (8, " \t\n ", "a", "en"), (9, "one", "a", "en"),
            (10, "Two Words", None, "en"), (11, "two words", "b", "en"), (12, prose(6, 30000), "c", "de"),
            (13, "Émile\x0bÀ la plage 日本語 \x1c x", "c", "fr"), (None, prose(7, 40), "a", "en"), (None, None, None, None),
            (20, prose(8, 45), "b", "en"), (20, prose(8, 45), "b", "en"), (21, (prose(9, 40) + " ") * 3, "a", "es")]
    return rows
