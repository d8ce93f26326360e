"""The rule lexicon: term lists and shapes as data, regular expressions made from them for two engines.

A rule is written once, with ``\\w \\s \\S \\d`` in their Unicode sense and ``^ $ .`` minding only line
feeds. ``java`` gives it for Spark, ``re2`` for engines without look-around and Unicode classes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_WORD = r"\p{L}\p{N}_"


def _classes(pattern: str, space: str, digit: str) -> str:
    """``pattern`` with explicit character classes in and outside of brackets."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if two in (r"\w", r"\s", r"\S", r"\d"):
            body = {"w": _WORD, "s": space, "S": space, "d": digit}[two[1]]
            out.append(body if inside else f"[^{body}]" if two == r"\S" else f"[{body}]")
            i += 2
            continue
        if c == "\\":
            out.append(two)
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, flags: str = "") -> str:
    """Pattern for Spark: Unicode classes, ``\\n`` as the only line end."""
    return f"(?dU{'iu' if 'i' in flags else ''}{'m' if 'm' in flags else ''}{'s' if 's' in flags else ''})" + _classes(pattern, r"\s\x1c-\x1f", r"\d")


def re2(pattern: str, flags: str = "") -> str:
    """Pattern for an RE2 engine; ``pattern`` must not look around."""
    return (f"(?{flags})" if flags else "") + _classes(pattern, r"\s\x0b\x1c-\x1f\x{85}\p{Z}", r"\p{Nd}")


@dataclass(frozen=True)
class Rule:
    """One counted pattern; a threshold is a density per 100 words that it must exceed to count."""

    key: str
    label: str
    pattern: str
    flags: str = ""
    dimension: str | None = None
    threshold: float | None = None

    @property
    def java(self) -> str:
        return java(self.pattern, self.flags)

    @property
    def re2(self) -> str:
        return re2(self.pattern, self.flags)


def any_of(terms: str) -> str:
    """Alternation of terms, given one a line or parted by ``;``."""
    return "|".join(t.strip() for t in re.split(r"[;\n]", terms) if t.strip())


def vocabulary(terms: str) -> str:
    return rf"\b({any_of(terms)})\b"


def opener(terms: str, after: str) -> str:
    """Terms at a line's start, behind blanks and list marks."""
    return rf"^[ \t>*\-]*({any_of(terms)}){after}"


# Fixed values of the English pack.
EN = (
    Rule("hedging", "hedging", vocabulary("it could be argued; some might say; it is important to note; it should be noted; it is worth mentioning; one might consider; arguably"), "i", "Directness"),
    Rule("vague_attribution", "vague attribution", vocabulary("experts (?:say|believe|argue|note); many (?:believe|argue); studies (?:show|suggest|indicate); research (?:shows|suggests); it is widely (?:accepted|believed|known)"), "i", "Directness"),
    Rule("transitional_cliche", "transitional cliche at line start", opener("Moreover; Furthermore; Additionally; In essence; It's worth noting; That said; In other words; Indeed; Notably; Importantly", r"\s*,"), "im", "Rhythm"),
    Rule("not_just_X_its_Y", "not just X but Y", r"\bnot just\s+[^.,;!?\n]{2,60}[,;.]?\s+(it'?s|but)\b|\bnot only\s+[^.,;!?\n]{2,80}\s+but\s+also\b", "i", "Rhythm"),
    Rule("explainer_voice", "explainer voice", vocabulary("let me explain; let'?s dive into; let'?s break (?:this|that|it) down; let me walk you through; let'?s explore; let'?s unpack; let me clarify"), "i", "Trust"),
    Rule("summary_loop", "summary loop", vocabulary("in conclusion; in summary; to summarize; overall; all in all; to wrap (?:up|things up); in closing"), "i", "Trust"),
    Rule("sycophantic_opener", "sycophantic opener", r"^\s*(" + any_of("Great question; Absolutely; Certainly; What a (?:great|fascinating|wonderful); I'd be (?:happy|delighted) to help; Excellent question; That'?s a (?:great|fantastic) question") + ")", "im", "Trust"),
    Rule("aphorism_formula", "aphorism formula", vocabulary("is not a tool but a mirror; becomes a trap"), "i"),
    Rule("chatbot_closer", "offer to continue", r"(want me to\b[^.?!]*\?|should i continue\?)", "i"),
    Rule("fake_candid_opener", "fake-candid opener", opener("Look; Here's the thing; The thing is; Let's be honest; Real talk; Honestly", r"\b[,?]"), "im"),
    Rule("puffery", "puffery", vocabulary("delve into; leverage; robust; comprehensive; seamless; holistic; synergy; paradigm; landscape of; ecosystem of; vibrant; cutting[- ]edge; state[- ]of[- ]the[- ]art; game[- ]changing; revolutionary; unparalleled; unprecedented"), "i", "Authenticity"),
    Rule("vocabulary_tells", "vocabulary tells", vocabulary("elucidate; myriad; plethora; tapestry; intricate(?:ly)?; navigate(?:s|d)? (?:the|this|these) (?:complex|complexities|challenges|landscape|terrain|world); paramount; quintessential; manifold; multifaceted"), "i", "Authenticity"),
    Rule("ai_apology", "apology", vocabulary("I apologize for (?:any |the )?(?:confusion|inconvenience|misunderstanding); my apologies for (?:any |the )?(?:confusion|inconvenience)"), "i", "Authenticity"),
    Rule("significance_inflation", "significance inflation", vocabulary("stands? as a testament; is a testament to; vital role; crucial role; pivotal (?:role|moment|point); reflects broader; set(?:s|ting)? the stage for; indelible mark; deeply rooted; marks? a (?:pivotal|significant|critical) (?:moment|point|turning point); key turning point; evolving landscape; underscores the (?:importance|need)"), "i", "Restraint"),
    Rule("fake_ing_analysis", "trailing -ing clause", r",\s+(" + any_of("creating; making; marking; representing; reflecting; symbolizing; highlighting; underscoring; shaping; contributing to; setting; paving; emphasizing; illustrating; demonstrating") + r")\s+\w+", "i", "Density"),
    Rule("ultimately_starter", "opener ultimately", opener("Ultimately", r"\s*,"), "im", "Density"),
    Rule("filler_phrases", "filler phrases", r"\bI hope this helps\b|\b(?:please )?(?:let me know if|feel free to (?:ask|reach out|let me know|share))\b|\bit'?s important to (?:note|remember|mention|understand|recognize)\b", "i", "Density"),
    Rule("em_dash_overuse", "dashes", r"—| — | – |(?<![\w])--(?!-)|(?<![\w])---(?!-)", "", "Punctuation"),
    Rule("boldface_overuse", "bold spans", r"\*\*[^*\n]{1,80}\*\*", "", "Density", 0.5),
    Rule("emoji_bullet", "emoji bullets", r"^[ \t]*(?:✅|✨|⭐|🌟|🚀|🎉|⚡|🔍|💡|🎯|📊|📝|📌|🔥|👍|💯|✔️|☑️|🔹|🔸)", "m", "Density"),
    Rule("rule_of_three", "lists of three", r"\b\w+,\s+\w+,?\s+and\s+\w+\b", "", "Restraint", 1.5),
    Rule("curly_quotes", "curly quotation marks", r"[‘’“”]"),
    Rule("title_case_heading", "title case headings", r"^#{1,6}\s+(?:[A-Z][a-z]+\s+){2,}[A-Z][a-z]+\s*$", "m"),
    Rule("placeholder_text", "placeholders", r"\[(?:INSERT|YOUR|BRAND|YEAR|COMPANY|NAME|TITLE|TODO|FILL|ADD CITATION|PLACEHOLDER)[^\]]*\]|\b\d{4}-xx-xx\b|<placeholder>|\bXXXX\b|___+", "i"),
    Rule("reference_markup_artifact", "reference markup", r"turn0(?:search|news|image)\d+|citeturn0\w+|oai_?citation|:contentReference\[oaicite|<grok_card[^>]*>|referrer=grok\.com|utm_source=(?:chatgpt|copilot|openai|grok)\.com|\?utm_source=chatgpt|\[web:\d+\]|\[attached_file:\d+\]", "i"),
    Rule("markdown_contamination", "markup and meta prompts", r"```(?:markdown|wikitext)\b|Would you like me to (?:convert|expand|add|reformat|adjust|rewrite)|Here(?:'s| is) the (?:formatted|rewritten|updated|revised) version|I (?:have|'ve) (?:rewritten|reformatted|updated) (?:the|this|your)", "i"),
    Rule("trailing_emphasis_fragment", "trailing fragments", r"[.!?]\s+(?:[A-Z][a-z'-]+(?:\s+[a-z][a-z'-]+){0,3})\s*[.!?]\s*(?:\n|$)"),
    Rule("fragmented_header", "fragmented headers", r"^#{1,6}\s+\S[^\n]*\n\s*\n(?:[A-Z][a-z'-]+(?:\s+[\w'-]+){0,10})\s*\.?\s*\n\s*\n", "m"),
    Rule("challenges_section", "challenges section", r"^#{1,6}\s+(?:Challenges?(?:\s+and\s+\w+)?|Future\s+Outlook|Future\s+Prospects?|Outlook|Despite\s+\w+|Limitations\s+and\s+\w+)\s*$|\bDespite (?:its\s+|these\s+)?(?:industrial\s+|economic\s+)?(?:challenges|prosperity|growth)[^.]{0,80}(?:continues\s+to\s+thrive|faces\s+(?:several\s+|many\s+|typical\s+)?challenges)\b", "im"),
)

_EN = {r.key: r for r in EN}
#: Rules of form that hold in any language and script.
UNIVERSAL = ("em_dash_overuse", "boldface_overuse", "emoji_bullet")
_E = "(?:e[rnsm]?)?"

# Fixed values of the German pack.
DE = (
    Rule("de_aphorism_formula", "aphorism formula", "(" + any_of("ist kein Werkzeug,? sondern ein Spiegel; wird zur Falle") + ")", "i"),
    Rule("de_significance_inflation", "significance inflation", vocabulary("steht für; dient als; ist ein Zeugnis; ist eine Erinnerung; eine (?:zentrale|bedeutende|entscheidende|wichtige|bedeutsame) Rolle; unterstreicht (?:seine|ihre|dessen) Bedeutung; spiegelt einen breiteren Trend wider; symbolisiert (?:sein|ihr) (?:anhaltendes|bleibendes) Vermächtnis; bereitet den Boden für; markiert einen Wendepunkt; sich wandelnde Landschaft; tief verwurzelt; spielt eine (?:zentrale|entscheidende|wichtige|bedeutende|bedeutsame) Rolle"), "i"),
    Rule("de_vague_attribution", "vague attribution", vocabulary("laut Experten; Branchenberichten? zufolge; wie Beobachter (?:festgestellt haben|zitiert haben); Einige Kritiker argumentieren; mehrere (?:Quellen|Publikationen); Quellen zufolge; wertvolle Erkenntnisse"), "i"),
    Rule("de_puffery", "puffery", vocabulary(f"verfügt über; lebendig; nahtlos{_E}; robust{_E}; hochmodern{_E}; bahnbrechend{_E}; renommiert{_E}; atemberaubend{_E}; beeindruckend{_E}; beispielhaft{_E}; unbedingt besuchen; zukunftsorientiert{_E}; wegweisend{_E}"), "i"),
    Rule("de_ai_vocab", "overused vocabulary", vocabulary(f"darüber hinaus; ganzheitlich{_E}; umfassend{_E}; facettenreich{_E}; transformativ{_E}; zukunftsweisend{_E}; maßgeblich{_E}; prägend{_E}; es ist wichtig zu betonen; in der heutigen Zeit; vor diesem Hintergrund"), "i"),
    Rule("de_copula_avoidance", "copula avoidance", vocabulary(r"gilt als; fungiert als; stellt\s+\S+\s+dar; erweist sich als; verkörpert; repräsentiert"), "i"),
    Rule("de_sycophancy", "sycophancy", r"(?:^|\.\s+|\!\s+)(Natürlich!|Gerne!|Selbstverständlich!|Super Frage!|Das ist eine (?:sehr )?gute Frage|Sie haben absolut Recht|Das ist ein ausgezeichneter Punkt|Vielen Dank für Ihre Frage)[!]?", "i"),
    Rule("de_filler", "filler phrases", vocabulary("Ich hoffe,? das hilft; Lassen Sie mich wissen; Lass mich wissen(?:,? ob)?; Es ist wichtig (?:zu beachten|zu betonen|festzuhalten),? dass; Es sei darauf hingewiesen,? dass; Es versteht sich von selbst,? dass; wie bereits erwähnt; es bleibt festzuhalten; an dieser Stelle"), "i"),
    Rule("de_signposting", "signposting", vocabulary("Lassen (?:Sie|wir) (?:uns )?(?:eintauchen|das aufschlüsseln); schauen wir uns (?:das|nun|einmal) an; sehen wir uns (?:nun|an); ohne weitere Umschweife; Im Folgenden (?:wird|werden|erläutern|behandeln); lassen Sie uns nun; hier ist,? was Sie wissen müssen"), "i"),
    Rule("de_sentence_opener_intensifier", "opening intensifier", opener("Letztendlich; Letztlich; Tatsächlich; Im Wesentlichen; Offensichtlich; Bemerkenswert; Bedeutsam; Fundamental", r"\s*[,.]"), "im"),
    Rule("de_quantity_vagueness", "vague quantity", vocabulary(f"eine breite Palette von; eine Vielzahl von; zahlreich{_E}; unzählig{_E}; eine Anzahl von; mehrere verschiedene; viele verschiedene"), "i"),
    Rule("de_academic_frame", "academic frame", r"\bim Rahmen der (?:vorliegenden|durchgeführten) (?:Arbeit|Studie|Untersuchung|Analyse|Recherche|Untersuchungen|Berichts?)\b", "i"),
    Rule("de_impersonal_reflexive", "impersonal reflexive", vocabulary("es lässt sich (?:feststellen|sagen|festhalten|zeigen|zusammenfassen); zusammenfassend lässt sich (?:sagen|feststellen|festhalten)"), "i"),
    Rule("de_denglisch", "anglicisms", vocabulary("alignen; scalen; leveragen; performen; highlighten; committen; challengen; tracken; briefen; pitchen; featuren; Pain Points?; Stakeholder[- ]Buy-in; Customer Journey; Value Proposition; User Mindset; ein nahtloses? Onboarding"), "i"),
    Rule("de_chatbot_closer", "offer to continue", r"(soll ich fortfahren\?|möchten sie,? dass ich\b[^.?!]*\?|soll ich beispiele geben\?)", "i"),
    Rule("de_fake_candid_opener", "fake-candid opener", opener(r"Mal ehrlich[,?]; Ganz ehrlich\?; Die Sache ist die,", ""), "im"),
    *(_EN[k] for k in UNIVERSAL),
)

PACKS: dict[str, tuple[Rule, ...]] = {"en": EN, "de": DE}
DIMENSIONS = ("Directness", "Rhythm", "Trust", "Authenticity", "Density", "Restraint", "Punctuation")

# Rule number -> counted patterns; a rule without any needs meaning or grammar and stays unmapped.
BRIDGE: dict[int, str] = {
    1: "significance_inflation puffery", 2: "", 3: "fake_ing_analysis", 4: "puffery", 5: "vague_attribution", 6: "challenges_section",
    7: "puffery vocabulary_tells", 8: "", 9: "not_just_X_its_Y", 10: "rule_of_three", 11: "", 12: "", 13: "", 14: "em_dash_overuse",
    15: "boldface_overuse", 16: "", 17: "title_case_heading", 18: "emoji_bullet", 19: "curly_quotes", 20: "sycophantic_opener filler_phrases",
    21: "hedging", 22: "sycophantic_opener", 23: "filler_phrases hedging", 24: "hedging", 25: "summary_loop", 26: "", 27: "explainer_voice",
    28: "explainer_voice transitional_cliche", 29: "fragmented_header", 30: "ultimately_starter transitional_cliche", 31: "", 32: "puffery",
    33: "", 34: "trailing_emphasis_fragment", 35: "", 36: "hedging", 37: "hedging", 38: "reference_markup_artifact", 39: "placeholder_text",
    40: "markdown_contamination",
}
# Rules of the quick mode and of the first routing.
QUICK_RULES = (7, 14, 17, 18, 19, 20, 22, 23, 38, 39, 40)
TIER1_RULES = (1, 4, 7, 20, 21, 22, 25)
# How far a rule applies in a domain (German pack); rules and domains that are not listed apply strictly.
LEVELS_DE = """
4 strict strict strict SKIP light
8 strict light strict light strict
10 light strict strict light light
11 light light light light light
13 SKIP SKIP light strict strict
15 strict strict SKIP light light
16 strict strict SKIP light light
23 light light strict strict strict
24 light SKIP strict strict strict
28 light light light light strict
30 normal normal strict light strict
32 strict strict strict light strict
33 strict strict strict light strict
34 strict strict strict light light
35 strict strict strict light strict
36 light light strict strict strict
37 strict strict strict light strict
100 strict strict strict strict strict
101 light light strict strict strict
102 light light strict strict strict
103 strict strict light light strict
104 light SKIP strict strict strict
"""
# Numbers and names of the rules that both packs share, of the English pack, and of rules in the German pack alone.
SHARED_RULES = {
    6: "Challenges and future prospects sections", 14: "Em dash overuse", 15: "Overuse of boldface", 17: "Title case in headings", 18: "Emojis", 19: "Curly quotation marks", 25: "Generic positive conclusions",
    26: "Hyphenated word pair overuse", 29: "Fragmented headers", 38: "Reference-markup artifacts", 39: "Phrasal templates and placeholder text", 40: "Markdown / wikitext contamination", 41: "Diff-anchored writing",
}
PACK_RULES = {
    1: "Undue emphasis on significance", 2: "Undue emphasis on notability", 3: "Superficial analyses with -ing endings", 4: "Promotional language", 5: "Vague attributions", 7: "Overused AI vocabulary",
    8: "Copula avoidance", 9: "Negative parallelisms", 10: "Rule of three overuse", 11: "Elegant variation", 12: "False ranges", 13: "Passive voice and subjectless fragments", 16: "Inline-header vertical lists",
    20: "Collaborative communication artifacts", 21: "Knowledge-cutoff disclaimers", 22: "Sycophantic tone", 23: "Filler phrases", 24: "Excessive hedging", 27: "Persuasive authority tropes", 28: "Signposting",
    30: "Sentence-starter intensifiers", 31: "Rhetorical questions", 32: "Stacked intensifier adjectives", 33: "Quantity vagueness", 34: "Trailing emphasis fragments", 35: "Debunking-pose headings",
    36: "Conditional frame stacking", 37: "Miscalibrated epistemic confidence", 42: "Aphorism formulas",
}
GERMAN_RULES = {100: "Academic frame phrase", 101: "Impersonal reflexive", 102: "Subjunctive stacking", 103: "Anglicisms", 104: "Nominal style inflation"}
LEVEL_DOMAINS = ("academic", "legal", "technical", "marketing", "career")


def pack(lang: str) -> tuple[Rule, ...]:
    """Rules of a language; an unknown language is an error, never an empty pack."""
    if lang not in PACKS:
        raise KeyError(f"no rules for language {lang!r}; known: {', '.join(sorted(PACKS))}")
    return PACKS[lang]


def rules(lang: str) -> dict[int, str]:
    """Numbers and names of a language's rules, shared ones included."""
    pack(lang)
    return SHARED_RULES | PACK_RULES | (GERMAN_RULES if lang == "de" else {})


def modes(lang: str) -> dict[str, list[int]]:
    """Rules of each mode: the quick one has a few, the voice mode those of the full one."""
    every = sorted(rules(lang))
    return {"quick": sorted(QUICK_RULES), "full": every, "voice": every}


def levels() -> list[tuple[int, str, str]]:
    """(rule, domain, level) of the override table."""
    return [(int(f[0]), d, x) for f in map(str.split, LEVELS_DE.strip().splitlines()) for d, x in zip(LEVEL_DOMAINS, f[1:])]
