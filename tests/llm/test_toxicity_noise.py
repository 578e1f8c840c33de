"""Toxicity with noisy labels, disguised insults and insults that only two words together make."""

import random
import zlib

from looseleaf.llm import toxicity


def corpus(noise):
    rng = random.Random(8)
    bad = ["idiot", "moron", "worthless", "pathetic"]
    rows, labels, truth = [], [], {}
    for i in range(900):
        words = [rng.choice("abcdefghklmnoprstu") + rng.choice(["and", "ere", "ing", "ost", "ull", "ake"]) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(8, 40))]
        words += ["drop", "dead"] if i % 2 else ["dead", "line"]  # both words are common by themselves
        rng.shuffle(words[:-2])
        words.insert(rng.randrange(3), rng.choice(["drop", "dead"]))
        toxic = i % 3 == 0
        at = rng.randrange(len(words) - 2)
        words[-2:] = ["line", "drop"]
        if toxic and i % 2:
            words[at:at] = ["drop", "dead"]
        elif toxic:
            words[at] = rng.choice(bad)
        truth[i] = toxic
        rows.append((i, " ".join(words).replace("dead drop dead", "drop dead") if toxic else " ".join(words).replace("drop dead", "dead drop")))
        labels.append((i, int(toxic != (rng.random() < noise))))
    return rows, labels, truth


def test_noise_gaps_and_phrases(spark):
    rows, labels, truth = corpus(0.05)
    disguised = {2000: "and i.d.i.o.t there", 2001: "see mo-ron here", 2002: "such an i d i o t there", 2003: "a worthxless one", 2004: "id!ot", 2005: "so PATHETTIC and sad", 2006: "drop dead now", 2007: "dead line drop", 2008: "drop the dead line", 2009: "a b c d and e f g"}
    df = spark.createDataFrame(rows + list(disguised.items()) + [(3000, None), (3001, ""), (3002, "!?")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(k, None) for k in disguised], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    missed = [i for i in held if truth[i] and not got[i].predicted]
    wrong = [i for i in held if not truth[i] and got[i].predicted]
    assert len(missed) <= 0.05 * sum(truth[i] for i in held) and len(wrong) <= 0.02 * len(held), (missed, wrong)
    assert [k for k in disguised if got[k].predicted] == [2000, 2001, 2002, 2003, 2004, 2005, 2006], {k: got[k].score for k in disguised}
    assert not any(got[k].predicted for k in (3000, 3001, 3002))


def test_copies_are_one_piece_of_evidence():
    base = {f"word{k}".encode() for k in range(50)}
    bags = [base, base | {b"extra"}, {f"other{k}".encode() for k in range(50)}]
    assert len(toxicity._without_copies(bags, [1, 1, 1])) == 2 and len(toxicity._without_copies(bags[:2], [0, 1])) == 2
