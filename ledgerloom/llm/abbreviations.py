"""Abbreviations and calendar words, by language, for sentence boundaries.

Common abbreviations of each language's spelling reference, kept as data: lower case, without the last
point. NEVER_LAST stand before a name or the rest of a phrase and never end a sentence; BEFORE_NUMBER
abbreviate before a number and may be words before anything else; MAYBE_LAST may also be a sentence's
last word.
"""

from __future__ import annotations

# Fixed values.
NEVER_LAST = frozenset("""
mr mrs ms messrs dr drs prof st mt lt sgt capt col gen gov sen rep rev hon maj cmdr supt pres fr hr sr sra srta dra dña mme mlle mgr
e.g i.e eg ie cf vs viz approx ca incl excl ext est tel max min resp dept ref ed eds ibid amt acct conf stmt estd
bzw vgl ggf evtl inkl exkl zzgl lt sog usf geb gest hrsg
aprox pág págs núm núms fig figs av avda bd ee al env lit art abs sec ch vol pp p ex para no nos nr
sig sigg dott dott.ssa avv ing geom rag pag pagg spett gent egr
dhr mevr mw bijv blz ca incl evt resp
sp ul os pl np tzn tj prof dr hab inż mgr
jfr f.eks bl.a mht
г-н г-жа см стр ул тыс млн млрд напр рис гл пер просп корп проф акад им
रु सं पृ डॉ श्री प्रो
ص د أ
""".split())  # fmt: skip
# Fixed values.
BEFORE_NUMBER = frozenset("""
no nos nr p pp s abs art sec ch fig vol ext para pág núm стр п д г гл op apt apto ste rm bldg flr blz pag lok tel
jan feb mar apr jun jul aug sep sept oct nov dec ene abr ago set out dez janv févr avr juil déc
""".split())  # fmt: skip
# Fixed values.
MAYBE_LAST = frozenset("""
etc usw u.s u.k u.s.a a.m p.m a.p.r a.p.y inc ltd co corp llc plc bros ave blvd rd sq jr gmbh ag uu ee.uu p.s b.c a.d ecc enz itd itp s.a s.r.l s.p.a b.v n.v o.o
jan feb mar apr jun jul aug sep sept oct nov dec mio mrd std руб коп г гг др т.д т.п м.д
""".split())  # fmt: skip
# Fixed values. Months after a day's ordinal point.
MONTHS = frozenset("""
januar jänner februar märz april mai juni juli august september oktober november dezember
leden únor březen duben květen červen červenec srpen září říjen listopad prosinec
""".split())  # fmt: skip
ORDINAL_BEFORE = frozenset("am zum vom der den dem das im beim bis ab seit die".split())
