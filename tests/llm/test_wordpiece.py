import random

from tidemark.llm import wordpiece
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.wordpiece import WORD, Automaton, load, token_counts


def greedy(initial, inner, word):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        n, at, pieces = n + 1, end, inner
    return n


def test_automaton_against_greedy_search():
    rng = random.Random(0)
    for _ in range(4000):
        some = lambda: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))}
        initial, inner = some(), some()
        automaton = Automaton(initial, inner)
        for _ in range(4):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
            assert automaton.count(word) == greedy(initial, inner, word), (initial, inner, word)


def test_linear_in_long_words():
    automaton = Automaton({"a"}, {"a", "a" * 50, "b"})
    assert automaton.count("a" * 100_001) == 1 + 100_000 // 50
    assert automaton.count("a" * 1000 + "b") == greedy({"a"}, {"a", "a" * 50, "b"}, "a" * 1000 + "b")


def test_texts(spark, odd_docs, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    vocabulary = load(path)

    rows = {(r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_counts(odd_docs, path).collect()}
    want = set()
    for r in odd_docs.collect():
        found = [vocabulary.count(w) for w in WORD.findall(r["text"] or "")]
        want.add((r["doc_id"], len(found), sum(1 if n is None else n for n in found), sum(n is None for n in found)))
    assert rows == want and token_counts(no_docs, path).count() == 0
    assert wordpiece.CACHE_MAX > 0
