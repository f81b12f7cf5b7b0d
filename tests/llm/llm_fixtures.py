"""A small table with every awkward case at once, and plain-Python counterparts of the operators."""

import random
import re
from collections import Counter

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key string, k1 string, size string, digest string, a string, line string, score string, prefix string"
)
VOCABULARY = {
    "en": "the of and window river stone bright yellow harbour people together morning nothing through which".split(),
    "de": "der und nicht straße fenster schön wasser über zwischen morgen gemeinsam häuser leuchtend strom".split(),
    "fr": "le et fenêtre rivière pierre lumière être ensemble matin rien où maison jaune près gens".split(),
    "es": "el y ventana río piedra mañana juntos nada dónde casa amarillo señor niño gente también".split(),
}


def sentence(rng, lang, words):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "", ",", "x", "q" + str(rng.randint(0, 99))]) for _ in range(words))


def corpus():
    """Rows of SCHEMA: texts in four languages, copies, near copies, shared passages, nulls, empties, a very long text."""
    rng = random.Random(4)
    passage = sentence(rng, "en", 120)
    rows = []

    def add(doc_id, text, lang, source):
        rows.append((doc_id, text, lang, source, None if text is None else len(text), "k", "j", "s", None, "a", "l", "0", "p"))

    for i in range(60):
        lang = rng.choice(list(VOCABULARY))
        text = "\n".join(sentence(rng, lang, rng.randint(3, 60)) for _ in range(rng.randint(1, 5)))
        add(i, text, lang if i % 9 else None, f"s{i % 4}" if i % 7 else None)
    texts = [r[1] for r in rows]
    for i in range(60, 75):  # exact copies, many of one text
        add(i, texts[3] if i < 70 else texts[i % 8], "en", "s0")
    for i in range(75, 85):  # near copies: one word in a long text
        words = (passage + " " + texts[5]).split(" ")
        words[rng.randrange(len(words))] = "changed"
        add(i, " ".join(words), "en", "s1")
    for i in range(85, 90):
        add(i, f"{sentence(rng, 'fr', 20)} {passage} {sentence(rng, 'fr', 20)}", "fr", "s2")
    add(90, None, "en", "s0")
    add(91, "", "en", "s0")
    add(92, " \n\t ", None, None)
    add(93, "1234 5678 !!", "en", "s1")
    add(94, "One", "en", "s1")
    add(95, "".join(rng.choice(["lang ", "wort ", "mot\n", "é", "ab"]) for _ in range(40_000)), "de", "s2")
    add(96, "a" * 3000, "es", "s3")
    add(97, texts[10].upper(), "en", "s3")
    add(None, texts[11], "en", "s0")
    add(None, texts[11], "en", "s0")
    add(7, texts[7], rows[7][2], rows[7][3])  # a repeated row
    add(98, "line one of some text\nline one of some texts\nline two <|endoftext|> x  y   z\x1c!\n\nline one of some text", "en", "s0")
    rng.shuffle(rows)
    return rows


def words(text):
    return WORD.findall((text or "").lower())


def shingle_counts(text, size=5):
    w = words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


class Classes:
    """Connected components by their least member."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
