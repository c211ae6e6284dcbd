import pytest
import regex as re

from tallyforge.functions import detect
from tallyforge.functions.patterns import _EDGE, rx
from tallyforge.operators import classify
from tallyforge.plans import parse

EVERY = [p for _, p in detect.DEVICES + detect.EQUIPMENT + detect.POLES] + [p for _, p, _ in detect.BOARDS + detect.LINE_BOARDS] + [p for _, _, _, ps, _ in classify.RULES for p in ps]
EVERY += [*parse.FORMATS.values(), *parse.SENTENCES.values(), *detect.CURVE_WORDS, detect.CURVE_REVISION, *detect.WAYS, r"\bs?x\b", r"\b\d*a\b", r"\b(x)y\b", r"\b(x|)y\b", r"\b(?:a?b)\b"]
TEXTS = [
    "16A MCB type C 2 x contactors", "AMCB MCBs MCB1 MCB_ RCBO", "DB-01 and SMDB 2A at DB.K.02", "way 12 cct 3 wayside", "L1 L12 XL1 L3", "P1 P5 P6 P12", "main lv panel, main switchboard", "TP&N TPN 1P+N 3 P", "12kA 10 kA 30mA",
    "sx x 5a a xy y b ab", "é1 1é éMCB MCBé", "Board Reference: 2A4 cable reference: X1", "type B curve C-curve Dcurve", "fed from MSB1 supplies DB-2", "",
]


@pytest.mark.parametrize("pattern", EVERY)
def test_word_edges_mean_the_same(pattern):
    """The shorter form of edges finds what the full one finds."""
    plain = re.compile(_EDGE.join(pattern.split(r"\b")).replace(r"\z", r"\Z"), re.I | re.A)
    quick = re.compile(rx(pattern, False).replace(r"\z", r"\Z"), re.I | re.A)
    for t in TEXTS:
        assert [m.span() for m in quick.finditer(t)] == [m.span() for m in plain.finditer(t)]
