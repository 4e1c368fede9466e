"""Folding against the plain form: a table asked for every letter, and a pattern for what is between words."""

import random
import re
import time
import unicodedata

from tessera.llm import mixing, toxicity

TABLE = str.maketrans(toxicity.HOMOGLYPHS | toxicity.FULLWIDTH)
GAP = re.compile(r"[\W_]+")


def plain(text):
    t = (text or "").lower()
    t = unicodedata.normalize("NFC", t) if not t.isascii() and not unicodedata.is_normalized("NFC", t) else t
    t = t.translate(TABLE)
    if any(d in t for d in "013457"):
        t = toxicity._mixed.sub(lambda m: m[0].translate(toxicity._digits), t)
    return f" {GAP.sub(' ', t).strip()} "


def test_fold_is_the_plain_form():
    rng = random.Random(1)
    usual = list("abcxyzABC 013457629_@$€  \n\t.,!|'-éÉİΣσςßﬁ²½٣中、。—“”\x1c\x1f\x85　ⅣǅÅ̊́\ud800") + list(toxicity.HOMOGLYPHS) + list(toxicity.FULLWIDTH)
    for k in range(6000):
        pool = usual if k % 3 else [chr(rng.randrange(rng.choice((0x80, 0x3000, 0x11000)))) for _ in range(200)]
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(300 if k % 10 == 0 else 40)))
        assert toxicity.fold(t) == plain(t)
    assert toxicity.fold(None) == plain(None) and toxicity.fold("＠＄@$") == plain("＠＄@$") == " as "


def test_a_text_is_not_walked_letter_by_letter():
    # Before, folding took as long as the plain form, and that was most of what a row of op2_mixing costs.
    text = " ".join(["Les élèves, l'été: «ça» va-t-il à la fête?"] * 500)

    def least(f):
        took = []
        for _ in range(7):
            start = time.process_time()
            for _ in range(5):
                f(text)
            took.append(time.process_time() - start)
        return min(took)

    assert least(toxicity.fold) < 0.6 * least(plain)


def test_places_and_figures_of_words():
    words = "one two two \ud800x Two 12 a_b one".split()
    n, x = mixing.describer()(" ".join(words))
    at = {mixing.zlib.crc32(w.encode("utf-8", "surrogatepass")) % mixing.WORDS for w in words}
    places = x[-mixing.WORDS :]
    assert n == 8 and {k for k in range(mixing.WORDS) if places[k]} == at and abs((places**2).sum() - 1) < 1e-12
    assert x[4] == 1 / 8 and x[5] == 6 / 8
