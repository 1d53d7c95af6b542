import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, n long, `row` long, content string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
PROSE = {
    "en": "the house on the hill was there when the children of the town came with their mothers and that was the end of the story",
    "fr": "la maison sur la colline était là quand les enfants de la ville sont venus avec leurs mères et ce fut la fin de cette histoire",
    "de": "das haus auf dem hügel war da als die kinder der stadt mit ihren müttern kamen und das war das ende von dieser geschichte",
}


def rows():
    """Nulls everywhere, empty, blank, very long and repeated texts, ties, repeated rows and ids."""
    base = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (7, LONG), (8, LONG + " end"), (9, "12 !? 34"), (9, "12 !? 34"), (10, "ÀÉ ß 日本語 😀 ▁ a  b"), (None, "one two three four"), (None, None), (11, "x" * 5000), (12, "ONE TWO"), (12, "other words under the same number")]
    out = [(i, t, None if k % 5 == 4 else "en", None if k % 4 == 3 else f"s{k % 3}", len(t or ""), 0.5, k, k, k, "clash") for k, (i, t) in enumerate(base)]
    for j, (lang, text) in enumerate(PROSE.items()):
        words = text.split()
        for k in range(40):
            turned = words[k % len(words) :] + words[: k % len(words)]
            out.append((100 + 50 * j + k, " ".join(turned), lang, f"s{k % 7}", 1, 0.0, 0, 0, 0, ""))
    return out


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
