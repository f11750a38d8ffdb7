import pytest
from made_up import prose


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a", 9), (1, prose(2, 60), "en", "a", 9), (2, "", "en", "a", 0), (3, None, None, None, None),
        (None, prose(3, 60), "de", "b", 5), (4, long, "de", "b", 1), (5, prose(2, 60), "fr", None, 1), (6, "! ?", "fr", "", 1),
        (7, "one line\n\n" + prose(4, 60), "en", "a", 1), (8, prose(5, 60) + "\n" + prose(4, 60), "en", "a", 1), (9, long, "en", "a", 1), (None, None, None, None, None),
    ]
    more = ["shard", "slot", "copy", "copies", "rate", "mix_order", "piece", "sequence_id", "offset", "score", "label", "id", "n", "b", "h", "_n", "_s", "_r", "_c", "_h", "_id", "_k", "_e", "removed_lines", "component_id", "n_copies", "media", "d"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in more)
    return spark.createDataFrame([(*r, *range(len(more))) for r in rows], schema).cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
