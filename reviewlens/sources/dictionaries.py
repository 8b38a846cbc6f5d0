"""Dictionaries and constants.

Every table here is a parameter of the operator that uses it; these are the defaults.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------------------------

# Label encoding used for the fine-tuning data and its inverse.
LABEL2ID = {"negative": 0, "positive": 1}

# Keyword aspects for single reviews: first aspect (in this order) whose keyword is a substring of
# the lower-cased sentence wins; no hit means "General".
API_ASPECT_KEYWORDS = [
    ("Acting", ["acting", "performance", "actor", "actress", "cast"]),
    ("Plot/Story", ["plot", "story", "storyline", "narrative"]),
    ("Cinematography", ["cinematography", "visuals", "shot", "camera", "framing"]),
    ("Pacing", ["pacing", "pace", "slow", "dragged", "rushed"]),
    ("Music/Score", ["music", "score", "soundtrack"]),
    ("Ending", ["ending", "finale", "conclusion"]),
    ("Direction", ["direction", "directing", "director"]),
    ("Dialogue/Writing", ["dialogue", "writing", "script", "lines"]),
]
DEFAULT_ASPECT = "General"

# Keyword sets for naming discovered topics: a topic goes to the aspect whose set shares the most
# words with the topic's top words (at least MIN_TOPIC_OVERLAP, first aspect in this order on ties).
TOPIC_ASPECT_KEYWORDS = [
    ("Acting", ["acting", "actor", "actress", "actors", "cast", "performance",
                "performances", "role", "supporting", "hes", "shes"]),
    ("Comedy/Humor", ["funny", "comedy", "laugh", "laughed", "laughing",
                      "jokes", "joke", "humor", "humour", "hilarious"]),
    ("Music/Score", ["music", "soundtrack", "song", "songs", "score",
                     "musical", "dance", "dancing", "sound"]),
    ("Plot/Story", ["plot", "story", "stories", "storyline", "plots",
                    "subplots", "narrative", "holes"]),
    ("Ending", ["ending", "end", "ends", "twist", "climax", "finale"]),
    ("Characters", ["characters", "character", "believable"]),
    ("Visual Effects/Cinematography", ["effects", "animation", "camera",
                                       "special", "cgi", "cinematography",
                                       "shots", "shot", "photography", "visual"]),
    ("Dialogue/Writing", ["script", "scripts", "dialogue", "written", "writing",
                          "direction"]),
    ("Pacing", ["minutes", "slow", "hours", "hour", "short", "long", "fast",
                "pace", "pacing", "length"]),
]
MIN_TOPIC_OVERLAP = 2

# Pipeline sizes.
MIN_REVIEW_CHARS = 10          # keep reviews strictly longer than this
MIN_SENTENCE_CHARS = 4         # batch sentence table drops shorter sentences
SAMPLE_SIZE = 50000            # topic step sample
SAMPLE_SEED = 42
TEST_SIZE = 0.2
SPLIT_SEED = 42
MAX_FEATURES = 10000
MIN_DF = 2
MAX_ITER = 1000
MIN_TOPIC_SIZE = 30
TOP_N_WORDS = 10
REPRESENTATIVE_DOCS = 3        # sample documents per topic
TOPIC_SUMMARY_ROWS = 25
MAX_PAGES_PER_FILM = 40
ENCODE_LENGTH = 256
GAUGE_POSITIVE = 65
GAUGE_NEGATIVE = 35

# ---------------------------------------------------------------------------------------------
# Lexicon scoring constants from the published rule-based method (Hutto & Gilbert, ICWSM 2014).
# ---------------------------------------------------------------------------------------------
BOOST_INCR = 0.293
BOOST_DECR = -0.293
CAPS_INCR = 0.733
NEGATION_SCALAR = -0.74
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
DAMP_2 = 0.95
DAMP_3 = 0.9
EXCLAIM_INCR = 0.292
EXCLAIM_MAX = 4
QUESTION_INCR = 0.18
QUESTION_CAP = 0.96
NORM_ALPHA = 15.0
POSITIVE_AT = 0.05
NEGATIVE_AT = -0.05

# Hand-made seed lists (ours, not the published ones; pass your own as parameters).
BOOSTERS_UP = ["absolutely", "amazingly", "completely", "deeply", "enormously", "entirely",
               "especially", "exceptionally", "extremely", "fully", "greatly", "highly",
               "hugely", "incredibly", "intensely", "really", "remarkably", "so", "strongly",
               "thoroughly", "totally", "tremendously", "truly", "utterly", "very", "most", "more"]
BOOSTERS_DOWN = ["almost", "barely", "hardly", "less", "little", "marginally", "occasionally",
                 "partly", "scarcely", "slightly", "somewhat", "sort", "kinda", "rather"]
NEGATIONS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere",
             "cannot", "without", "aint", "isnt", "wasnt", "dont", "doesnt", "didnt", "cant",
             "couldnt", "wont", "wouldnt", "shouldnt", "havent", "hasnt", "hadnt", "arent",
             "werent", "rarely", "seldom", "despite"]
# Phrase rules of the published method: fixed valences of idioms, dampening phrases, and words after "never".
IDIOMS = [("bad ass", 1.5), ("beating heart", 3.1), ("broken heart", -2.9), ("bus stop", 0.0), ("kiss of death", -1.5),
          ("the bomb", 3.0), ("to die for", 3.0), ("yeah right", -2.0)]
PHRASE_DAMPENERS = ["kind of"]
NEVER_SCALAR = 1.25            # "never so good", "never this good" strengthen
NEVER_WORDS = ["so", "this"]
LEAST_KEEPS = ["at", "very"]   # "at least" and "very least" do not negate
SEED_LEXICON = [
    ("good", 1.9), ("great", 3.1), ("excellent", 2.7), ("amazing", 2.8), ("wonderful", 2.7),
    ("love", 3.2), ("loved", 2.9), ("like", 1.5), ("liked", 1.8), ("best", 3.2), ("fun", 2.3),
    ("beautiful", 2.9), ("brilliant", 2.8), ("enjoyed", 2.3), ("perfect", 2.7), ("nice", 1.8),
    ("bad", -2.5), ("worst", -3.1), ("awful", -2.0), ("terrible", -2.1), ("boring", -1.3),
    ("hate", -2.7), ("hated", -3.2), ("poor", -2.1), ("waste", -1.8), ("stupid", -2.4),
    ("dull", -1.7), ("horrible", -2.5), ("disappointing", -2.2), ("mess", -1.5), ("weak", -1.9),
]

ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e"]

# Reserved ids of the fixed-length encoder; word ids start after them.
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
FIRST_WORD_ID = 5


# Spark ML's default English stop words (Apache Spark, org/apache/spark/ml/feature/stopwords,
# Apache License 2.0). Kept here so that importing the package reads no file.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll
she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's
who's why's would
""".split())


def spark_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop-word list."""
    return ENGLISH_STOP_WORDS
