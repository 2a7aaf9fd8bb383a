import pytest

from tesserae.functions.stem import stem

#: Vectors of the published sample vocabulary, as word and stem.
PUBLISHED = """
consign consign|consigned consign|consigning consign|consignment consign|consist consist|consistency consist|consistently consist|consists consist
consolation consol|consolatory consolatori|console consol|consolidate consolid|consolidating consolid|consolingly consol|consols consol|consonant conson
conspicuously conspicu|conspiracy conspiraci|conspirators conspir|conspire conspir|constable constabl|constancy constanc|constant constant
knackeries knackeri|knaves knave|knavish knavish|kneaded knead|kneel kneel|knees knee|knif knif|knife knife|knightly knight|knitted knit|knitting knit|knives knive
knockers knocker|knots knot
"""
#: What the rules say, step by step.
RULES = """
caresses caress|ties tie|cries cri|gas gas|this this|gaps gap|kiwis kiwi|skies sky|dying die|news news|inning inning|proceed proceed|proceeded proceed
agreed agre|feed feed|luxuriated luxuri|hopping hop|hoping hope|cry cri|by by|say say|enjoy enjoy|relational relat|rationally ration|generate generat|generic generic
communism communism|community communiti|arsenal arsenal|organization organ|apology apolog|possibly possibl|adoption adopt|rate rate|roll roll|controlling control
yes yes|youth youth|boyish boyish|beds bed|bead bead|using use|the the|and and|ing ing|x x|héros héros
"""


@pytest.mark.parametrize("pair", [x for text in (PUBLISHED, RULES) for line in text.strip().split("\n") for x in line.split("|")])
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want
