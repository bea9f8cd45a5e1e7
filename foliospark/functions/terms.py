"""Words and phrases that tell what a document is about, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import text

# Particles at the end of Korean words, of several letters and of one.
PARTICLES = ["에서의", "으로써", "으로서", "에서", "으로", "까지", "부터", "에는", "와의", "과의", "들의", "들을", "들이"]
SHORT_PARTICLES = ["을", "를", "은", "는", "이", "가", "의", "에", "와", "과", "도", "로"]
# Words that say nothing in filed documents.
STOP_WORDS = [
    "및", "또는", "위한", "이를", "포함", "하는", "있는", "이상", "관한", "장치", "방법", "제조", "이용", "the", "and", "for", "with", "using", "method", "apparatus", "device", "thereof", "same", "based",
    "해결", "해결하기", "해결하는", "제공", "제공하는", "특징", "특징으로", "개선", "발명", "대한", "있어서", "구비", "구비한", "형성", "형성된", "포함하는", "따른", "통해", "위해", "관련",
    "구조", "부재", "부분", "표면", "상부", "하부", "내부", "외부", "상기", "사용", "적용", "가능", "효과", "문제", "다양", "각각", "복수", "하나", "구성", "배치", "연결", "기재", "단계", "실시", "실시예", "도면", "경우",
    "기반", "분야", "이용한", "이용하여", "적어도", "해당", "적용한", "기술", "invention", "present", "claim", "wherein", "comprising", "said", "first", "second", "plurality", "least", "one", "having", "includes",
]
# Stop words of class labels' keywords.
LABEL_STOP_WORDS = ["및", "또는", "위한", "있는", "하는", "the", "and", "for", "with", "of", "in", "to", "method", "device", "system", "장치", "방법"]
#: Runs of two Hangul or ASCII letters or more; what no phrase goes across.
WORD, BREAK = "[가-힣A-Za-z]{2,}", r"[.,;:·()\[\]{}/|]|및|또는"
#: The same with CJK letters, kana and digits, for class labels' keywords.
LABEL_WORD = "[A-Za-z가-힣一-龥ぁ-んァ-ン0-9]{2,}"
#: Two letters or more stay before a particle; that of several letters is taken off first, and then no other.
_STEM = f"^(..+?)(?:{'|'.join(PARTICLES)})$"
_SHORT_STEM = f"^(..+)[{''.join(SHORT_PARTICLES)}]$"


def stem(word: Column) -> Column:
    """A word in lower case without its particle."""
    w = F.lower(word)
    return F.when(w.rlike(_STEM), F.regexp_replace(w, _STEM, "$1")).otherwise(F.regexp_replace(w, _SHORT_STEM, "$1"))


def clean_tokens(c: Column, stop: list[str] | None = None) -> Column:
    """The stems of a text's words in order, without stop words."""
    stopped = F.array(*map(F.lit, STOP_WORDS if stop is None else stop))
    return F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(WORD), 0), stem), lambda w: (F.length(w) >= 2) & ~F.array_contains(stopped, w))


def document_terms(c: Column, stop: list[str] | None = None) -> Column:
    """The distinct stems of a text, and pairs of neighbours that differ, within punctuation and conjunctions."""
    per = F.transform(F.split(text(c), BREAK), lambda s: clean_tokens(s, stop))
    most = F.lit(0)
    two = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, most)), F.slice(w, 2, F.greatest(F.size(w) - 1, most)), lambda a, b: F.when(a != b, F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(F.flatten(per), F.filter(F.flatten(F.transform(per, two)), lambda x: x.isNotNull())))


def label_words(c: Column) -> Column:
    """All words of a text in lower case (repeats included) that may be keywords of a class."""
    stopped = F.array(*map(F.lit, LABEL_STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit(LABEL_WORD), 0), lambda w: ~F.array_contains(stopped, w))
