"""Words and syllables: against the patterns that define them, and without an array of matches for each text."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from mailquarry.functions import syllables
from mailquarry.functions.text import SPACE, plain_spaces, single_spaced, word_count, word_letters
from mailquarry.operators import content

WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x202F, 0x205F, 0x3000)]
PIECES = [*"aeiouyqwxzbcd.!?-0", *" \t\n\r\x0b\x0c\x1c\x1f", *WIDE, "\u200b", "\u2010", "\u3001", "\u00e9", "\U0001f600", "table", "the"]
CLASS = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", SPACE)


def texts():
    pick = random.Random(7)
    return ["", " ", "e", "aee", "tree e", "mate", "a\u3000", *("".join(pick.choices(PIECES, k=pick.randrange(60))) for _ in range(400))]


def expected(text):
    words = re.findall(f"[^{CLASS}]+", text)
    silent = [w for w in words if re.fullmatch("[^aeiouy]*[aeiouy]+[^aeiouy]+.*e", w, re.S)]
    return len(words), len(re.findall("[aeiouy]+", text)) - len(silent) + sum(not re.search("[aeiouy]", w) for w in words)


def test_words_and_syllables_against_the_patterns(monkeypatch):
    for chunk in (1, 50, 1 << 20):
        monkeypatch.setattr(syllables, "CHUNK", chunk)
        for kind in (pa.string(), pa.large_string()):
            got = syllables._counted(pa.array(["x", *texts(), None], kind)[1:]).to_pylist()
            assert [(r["words"], r["syllables"]) for r in got] == [*map(expected, texts()), (0, 0)]
    assert len(syllables._counted(pa.array([], pa.string()))) == 0


def test_words_and_letters_from_single_spaces(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string").withColumn("plain", plain_spaces(F.col("t")))
    rows = rows.withColumn("s", single_spaced(F.col("t"), F.col("plain"))).withColumn("letters", word_letters(F.col("s")))
    for r in rows.withColumn("words", word_count(F.col("s"), F.col("letters"))).collect():
        assert (r.words, r.letters) == (expected(r.t)[0], len(re.sub(f"[{CLASS}]", "", r.t)))


def test_no_array_of_all_words_is_built(spark):
    """regexp_count makes an array of its matches: one string for each word or group of vowels of a body."""
    mails = spark.createDataFrame([("m", "s", "en", "a b", "text", "x")], "message_id string, sender string, lang string, content string, content_type string, subject string")
    for found in (content.content_features(mails), content.style(mails)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "aeiouy" not in plan and f"[^{SPACE}]+" not in plan
