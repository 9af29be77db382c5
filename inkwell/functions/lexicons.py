"""Word lists, patterns and bounds whose values decide results."""

from __future__ import annotations

# --- Fixed values ---------------------------------------------------------------------------------------------

# Lines of licence and production notes; case is ignored.
BOILERPLATE_LINES = (
    r"^\s*Produced by .*$",
    r"^\s*Transcriber('|’)s Note[:s]*.*$",
    r"^\s*\[Transcriber('|’)s Note.*?\]\s*$",
    r"^\s*This (?:e[Bb]ook|etext) is for the use of anyone.*$",
    r"^\s*Updated editions will replace.*$",
    r"^\s*Creating the works from (?:public domain|print).*$",
    r"^\s*www\.gutenberg\.(org|net).*$",
    r"^\s*Title:\s.*$",
    r"^\s*Author:\s.*$",
    r"^\s*Release [Dd]ate:\s.*$",
    r"^\s*Language:\s.*$",
    r"^\s*Character set encoding:\s.*$",
    r"^\s*Credits?:\s.*$",
    r"^\s*eBook No\.?:.*$",
    r"^\s*Most recently updated:.*$",
    r"^\s*Project Gutenberg('|’)s .*, by .*$",
)
BODY_START = r"\*{3}\s*START OF (?:THE|THIS) PROJECT GUTENBERG[^\n]*\*{3}"
BODY_END = r"\*{3}\s*END OF (?:THE|THIS) PROJECT GUTENBERG[^\n]*\*{3}"
OLD_END = r"^\s*End of (?:the )?Project Gutenberg(?:'s)? Etext.*$"
SMALL_PRINT = r"\*END\*THE SMALL PRINT.*?(?=\n\n)"

CHAPTER_HEADING = r"^\s*(CHAPTER|Chapter|BOOK|Book|PART|Part|PROLOGUE|Prologue|EPILOGUE|Epilogue|VOLUME|Volume)\b.{0,60}$"
ROMAN_HEADING = r"^\s*[IVXLCDM]{1,8}\.?\s*$"
BACK_MATTER = r"(?i)^\s*(APPENDIX|GLOSSARY|INDEX|FOOTNOTES?|NOTES?|BIBLIOGRAPHY|ACKNOWLEDGEMENTS?)\s*\.?\s*$"
CONTENTS = r"(?i)^\s*(CONTENTS|TABLE OF CONTENTS)\s*\.?\s*$"
CONTENTS_LEADER = r"\.{2,}|\s{2,}\d{1,4}\s*$"
CONTENTS_WITHIN_LINES, PROSE_WORDS, PROSE_CHARS = 2000, 20, 150

FOOTNOTE_BLOCK = r"(?is)\[\s*Footnote[^\]]*\]"
EDITOR_NOTE = r"(?is)\[[^\]]{0,300}?(translator|editor|transcriber)[^\]]{0,300}?\]"
FOOTNOTE_MARK = r"\[\s*\d{1,3}\s*\]"

TYPOGRAPHY = (
    ("“", '"'), ("”", '"'), ("„", '"'), ("‟", '"'),
    ("‘", "'"), ("’", "'"), ("′", "'"),
    ("–", "-"), ("—", "--"), ("―", "--"),
    ("﻿", ""), (" ", " "),
)

ABBREVIATIONS = (
    "mr mrs ms dr st vs etc mssrs jr sr prof col gen capt lieut rev hon esq no vol pp cf"
).split()
SENTENCE_STARTS = "A-ZА-ЯЁӘҒҚҢӨҰҮҺІ\"'“"
DIALOGUE_OPEN, DIALOGUE_CLOSE = ('"', "'", "“", "‘"), ('"', "'", "”", "’")
CYRILLIC_SHARE = 0.15

COMMON_WORDS = (
    "the of and a to in is was he that it for you his with as had her not on at "
    "by have be i this but from they we she or an will my one all would there "
    "their what so up out if about who get which go me when make can like time "
    "no just him know take people into year your good some could them see other "
    "than then now look only come its over think also back after use two how our "
    "work first well way even new want because any these give day most us"
).split()

FUNCTION_WORDS = sorted(set((
    "a about above after again against all am an and any are aren't as at be "
    "because been before being below between both but by can't cannot could "
    "couldn't did didn't do does doesn't doing don't down during each few for "
    "from further had hadn't has hasn't have haven't having he he'd he'll he's "
    "her here here's hers herself him himself his how how's i i'd i'll i'm i've "
    "if in into is isn't it it's its itself let's me more most mustn't my myself "
    "no nor not of off on once only or other ought our ours ourselves out over "
    "own same shan't she she'd she'll she's should shouldn't so some such than "
    "that that's the their theirs them themselves then there there's these they "
    "they'd they'll they're they've this those through to too under until up "
    "very was wasn't we we'd we'll we're we've were weren't what what's when "
    "when's where where's which while who who's whom why why's with won't "
    "would wouldn't you you'd you'll you're you've your yours yourself "
    "yourselves upon whilst thou thee thy ye"
).split()))

PUNCTUATION = (",", ";", ":", "!", "?", ".", "-", "—", '"', "'", "(", ")", "“", "”", "’")

STRONG_MARKERS = (
    "delve", "delving", "delves", "tapestry", "boundaries", "underscore", "underscores", "underscoring",
    "seamless", "seamlessly", "leverage", "leveraging", "multifaceted", "intricacies", "holistic",
    "holistically", "paradigm shift", "synergy", "synergistic", "cutting-edge", "state-of-the-art",
    "ever-evolving", "ever-changing", "it is important to note", "it's important to note",
    "it is worth noting", "it's worth noting", "plays a crucial role", "plays a significant role",
    "pivotal role", "a testament to", "is a testament", "unwavering commitment", "unwavering dedication",
    "invaluable", "comprehensive understanding", "garnered", "garner", "bolster", "bolstering",
    "embark on a journey", "resonates deeply", "myriad of", "plethora of", "in the realm of",
    "at the heart of", "when it comes to", "navigate the complexities", "navigate the", "as an ai",
    "as a language model", "i cannot", "i don't have personal", "i don't have the ability",
    "foster a deeper understanding", "rich tapestry", "vibrant tapestry",
)
WEAK_TRANSITIONS = (
    "moreover", "furthermore", "additionally", "in conclusion", "notably", "arguably", "in essence",
    "in summary", "to summarize", "overall,", "consequently", "therefore,", "thus,", "indeed,",
    "however,", "nonetheless,", "nevertheless,", "in addition,", "on the other hand,", "as a result,",
)
ANACHRONISMS = ("internet", "online", "email", "smartphone", "computer", "website", "app", "software", "algorithm", "data-driven")
OPENERS = ("In today's", "In this", "This comprehensive", "This essay", "This analysis")

# Signals of machine writing: their weights, the patterns they count and where each is full.
SIGNAL_WEIGHTS = {"lexicon": 0.25, "discourse": 0.25, "list_of_three": 0.10, "uniformity": 0.15, "paragraph_uniformity": 0.15, "markup": 0.10}
TRIPLE = r"(?U)\b\w+(?:,\s+\w[\w'-]*){1,2},?\s+(?:and|or)\s+\w[\w'-]*\b"
MARKUP = (r"(?m)^\s*[-*•]\s+\S", r"(?m)^\s*\d{1,2}[.)]\s+\S", r"(?m)^\s{0,3}#{1,6}\s+\S", r"\*\*[^*\n]{2,60}\*\*")
CONTRACTION = r"(?iU)\b\w+'(?:t|re|ve|ll|d|s|m)\b"
FIRST_PERSON = r"(?U)\b(?:I|me|my|mine|we|us|our)\b"
STRONG_POINTS, WEAK_POINTS, MODERN_POINTS, LEXICON_FULL = 3.0, 1.0, 2.0, 10.0
LEAST_SENTENCES, OPENERS_FULL, TRIPLES_FULL = 3, 0.35, 2.0
SENTENCE_VARIATION, SENTENCE_WIDTH, PARAGRAPH_VARIATION, PARAGRAPH_WIDTH = 0.55, 0.4, 0.70, 0.5
LEXICON_WORDS, TRIPLE_WORDS, MARKUP_WORDS = 1000.0, 500.0, 300.0

LENGTH_BANDS = ((200, "<200"), (400, "200-400"), (800, "400-800"), (1500, "800-1500"))
SCALE_BANDS = ((900, "large"), (600, "medium"), (250, "semi_small"), (60, "window"))

# --------------------------------------------------------------------------------------------------------------
