from tidemark.llm.quality import CHUNK, Featurizer


def test_a_text_without_blanks_counts_to_its_end():
    find, head = Featurizer(), b"abcdefgh" * 8
    assert len(head) == CHUNK
    one, other = find(head + b"spam" * 20 + b"9A9"), find(head + b"good" * 20 + b"9A9")
    assert len(one.keys() - other.keys()) >= 3  # words and beginnings of later chunks, not only the hash of the whole
    assert find(head + b"tail word") == find(head + b" tail word")
