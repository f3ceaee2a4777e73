"""Remembered words of op8_lexical_packing: each is encoded once, whatever sign follows it, with the ids of whole texts."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prismill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_word_is_remembered_once_whatever_sign_follows():
    known = packing.WordIds(PATH)
    known.encode(["Gromble gromble. gromble, gromble! Größe: größe; größe?\ngromble."], 2)
    assert {w for w in known.codes if "gromble" in w or "größe" in w} == {"gromble", "größe"}
    # Words that are known need no learning; the end of a line or of a text ends them.
    learn, asked = known.learn, []
    known.learn = lambda words: (asked.extend(words), learn(words))
    again = known.encode(["größe. gromble,", "gromble!\ngröße\t"], 2)
    assert set(asked) <= {""}
    assert [len(x) for x in again] == [len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids) + 1 for t in ("größe. gromble,", "gromble!\ngröße\t")]


@pytest.mark.parametrize("remembered", [3, 600_000])
def test_signs_behind_every_letter(monkeypatch, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    known, plain = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    signs = [".", ",", "?!", "'s.", "'S,", "'.", "..", ".a", "5.", ".\x0b", ".\xa0", "́.", "　.", ";\r\n", ":\x0c.", ""]
    letters = [chr(k) for k in [*range(33, 0x600), *range(0x1E00, 0x2100), *range(0x3040, 0x3100)]]
    texts = [" ".join(c + s for c in letters[k : k + 16] for s in signs) for k in range(0, len(letters), 16)] + ["", ".", " . ", "a.", "a. b. c.", "İ. Σ. ẞ! <|x. "]
    for text, found in zip(texts, known.encode(texts, 2)):
        assert found.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], text
    assert [x.tolist() for x in known.encode(["", ""], 2)] == [[2], [2]] and packing.WordIds(PATH).encode([""], 2)[0].tolist() == [2]


def test_words_are_forgotten_where_a_task_ends(spark):
    """What a worker keeps would count in every later stage that it serves."""
    docs = spark.createDataFrame([(k, f"some words and number{chr(97 + k)} of them") for k in range(20)], "id long, text string").coalesce(1)
    kept = []

    def count(batches):
        rows = list(batches)
        yield from packing_run(iter(rows))
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([len(packing.word_ids(PATH).codes)]), pa.array([b""])], ["id", "key", "h", "ids"])

    class Frame:
        """Stands for a frame, to get at what runs in its tasks."""

        schema = docs.schema

        def mapInArrow(self, run, schema):  # noqa: N802
            kept.append((run, schema))

    packing.tokenised(Frame(), PATH, 2, "<u2")
    packing_run, schema = kept[0]
    found = docs.mapInArrow(count, schema).collect()
    assert len(found) == 21 and [r.h for r in found if r.id == -1] == [0]
