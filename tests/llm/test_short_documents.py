"""Documents a little shorter than a benchmark item."""

from looseleaf.llm import decontaminate


def test_a_document_shorter_than_the_item_is_compared_whole():
    item = [f"word{k}" for k in range(50)]
    index = decontaminate.ItemIndex([(1, " ".join(item).encode()), (2, b"quite another text of more than five words")])
    for part in (item[:48], item[2:], item[1:49]):
        ((which, a, b, s),) = index.hits(" ".join(part).encode(), 0.8)
        assert (which, a, b) == (1, 0, 48) and 0.9 < s < 1
    assert index.hits(" ".join(item[:35]).encode(), 0.8) == [] and index.hits(" ".join(item[:20] + ["x"] + item[20:48]).encode(), 0.95) == []
    assert index.hits(b"word1 word2", 0.8) == []
