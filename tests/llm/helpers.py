"""Edge-case documents and brute-force versions shared by the tests of the training-data operators."""

import collections
import random
import zlib

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, block string, `key` int, n string"


def prose(rng, n, words=("the", "of", "and", "house", "river", "stone", "light", "green", "walks", "under", "a", "in", "small",
                         "bird", "sings", "morning", "old", "road", "to", "is")):
    return " ".join(rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, a null id, other scripts."""
    rng = random.Random(7)
    long_text = prose(rng, 20_000)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "Released under the MIT License.\nMIT license, mit-license!"),
             (4, "Released under the MIT License.\nMIT license, mit-license!"), (5, long_text), (6, "One two"), (7, "one TWO"),
             (8, "İstanbul ΣΑΣ ῾Ελλάς ½ café naïve 漢字 한글 🙂 é <|endoftext|> it's we'll"), (9, base), (10, near),
             (11, base), (12, "word"), (13, "12345 67 %% --"), (14, prose(rng, 300)), (15, prose(rng, 50) + " x y\x1cz"),
             (None, "a text without an id"), (None, None)]
    return [(d, t, "en" if d and d % 2 else None, "src", "clash", 1, "clash") for d, t in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, k, percent=80):
    """doc_id -> (set size, smallest id of its component) by comparing every pair with a common shingle."""
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = collections.defaultdict(list)
    for d in sorted(sets):
        for other in {o for g in sets[d] for o in having[g]}:
            i = len(sets[d] & sets[other])
            if 100 * i >= percent * (len(sets[d]) + len(sets[other]) - i):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
        for g in sets[d]:
            having[g].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}
