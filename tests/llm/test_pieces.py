import numpy as np
import pytest
import sentencepiece

from docloom.llm import common, sentence_pieces as s

TEXTS = ["", " ", "  ", "a", "Hello world", "  two  blanks   here ", "tab\tand\nline\r\n\nend", "é ü ñ 日本語 🤗 𝒳", "literal ▁ mark ▁▁", "x" * 3000, "ab" * 500, " " * 70 + "z", "\ufffd \uffff", "don't stop!! 12,345.67"]


@pytest.fixture(scope="module")
def model():
    with open(s.default_model(), "rb") as f:
        return s.Model(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=s.default_model())


def test_same_pieces_as_the_library(spark, model, library):
    texts = TEXTS + [r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    got = model.encode(texts)
    for t, ids, want in zip(texts, got, library.encode(texts)):
        if s.MARK not in t:
            assert ids.tolist() == want, t
        assert model.decode(ids.tolist()) == t


def test_unigram_paths_are_the_best(model):
    uni = s.Model.__new__(s.Model)
    uni.__dict__.update(model.__dict__)
    uni.bpe = False
    uni.unknown = float(uni.score[3:].max()) - 40000
    score = uni.score.copy()
    score[score < -1e8] = -50000.0
    uni.score = score

    def best(word):
        table = [(0.0, [])]
        for i in range(1, len(word) + 1):
            options = []
            for j in range(max(0, i - uni.longest), i):
                p = uni.ids.get(word[j:i])
                if p is not None and (uni.rank[p] >= 0) and not (i - j > 1 and set(word[j:i]) == {s.MARK}):
                    options.append((table[j][0] + float(score[p]), [*table[j][1], p]))
                elif i - j == 1:
                    options.append((table[j][0] + uni.unknown, [*table[j][1], -1 - ord(word[j])]))
            table.append(max(options, key=lambda o: o[0]))
        return table[-1][0]

    words = ["▁hello", "▁world", "▁thest", "▁ération", "zq日x"]
    for w in words:
        for got in (uni._viterbi([w])[0], uni._viterbi_alone(w)):
            ids = np.frombuffer(got, np.int32).tolist()
            spelled = [i for i in ids if uni.byte[0] <= i <= uni.byte[255]]
            assert b"".join(uni.raw[i] for i in ids).decode() == w.replace(s.MARK, " ")
            missing = sum(c not in uni.ids for c in w)
            assert np.isclose(sum(float(score[i]) for i in ids if i not in spelled) + missing * uni.unknown, best(w))


def test_long_words_follow_the_same_paths(model, library):
    letters = "".join(w for w in "The quick brown fox jumps over the lazy dog and runs away from here".split()) * 40
    for size in (s.LONGEST - 1, s.LONGEST, s.LONGEST + 1, 300, 2000):
        for k in range(5):
            w = letters[7 * k : 7 * k + size]
            assert model._viterbi([w])[0] == model._viterbi_alone(w)
            assert model.encode([w])[0].tolist() == library.encode(w)


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(s, "MEMORY", 40_000)
    memory = s.Memory()
    texts = [" ".join(f"word{i * 37 % 1000}x{i}" for i in range(k, k + 50)) for k in range(0, 2000, 25)]
    assert [x.tolist() for t in texts for x in model.encode([t], memory)] == [x.tolist() for x in model.encode(texts)]
    assert memory.held < 40_000 and len(memory.young) + len(memory.old) < 400


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "a  b", "z"), (2, "a  b", "z")], "doc_id long, text string, piece_ids string")
    done = s.decode(s.encode(df)).collect()
    assert [r.decoded for r in done] == ["", "", "a  b", "a  b"] and done[0].piece_ids == []
    assert s.decode(s.encode(df.limit(0))).count() == 0
    both = s.round_trip(df.withColumn("exact", s.F.lit(0))).collect()
    assert all(r.exact is True for r in both) and [r.piece_ids for r in both] == [r.piece_ids for r in done]
    assert s.round_trip(df.limit(0)).count() == 0
    small = s.op2_sentence_pieces(spark, "/root/testdata/sf0.001")
    assert small.where("NOT exact").count() == 0 and small.count() == 200
