"""Results depend on them, so they are stated in one place."""

# --- missing-value words (case-sensitive) ---------------------------------------------
MISSING_TOKENS = ("", "NULL", "null", "None", "NaN", "nan", "N/A", "NA", "n/a")
# upper-cased words the raw anomaly scan treats as missing
MISSING_WORDS_UPPER = ("", "NULL", "NONE", "NAN", "N/A", "NA")

# --- platforms --------------------------------------------------------------------------
PLATFORM_ALIASES = {
    "twitter": "Twitter",
    "x": "Twitter",
    "facebook": "Facebook",
    "fb": "Facebook",
    "instagram": "Instagram",
    "insta": "Instagram",
    "youtube": "YouTube",
    "reddit": "Reddit",
}
UNSPECIFIED = "Unspecified"
PLATFORMS = ("Twitter", "Facebook", "Instagram", "YouTube", "Reddit", UNSPECIFIED)

# --- expected window of the posts (half-open) ----------------------------------------
WINDOW_START = "2024-05-01"
WINDOW_END = "2025-05-01"

ANOMALY_TYPES = ("NEGATIVE_LIKES", "MISSING_PLATFORM", "MISSING_TEXT", "HTML_ENTITY_OR_TAG")

# --- sentiment lexicon of the exploratory statistics --------------------------------
LEXICON = {
    "loving it": 2,
    "highly recommend": 2,
    "exceeded my expectations": 2,
    "best purchase ever": 2,
    "worth every penny": 1,
    "impressive": 1,
    "can't wait": 1,
    "mixed feelings": 0,
    "bummed": -2,
    "not worth the money": -2,
    "had issues": -2,
    "wouldn't recommend": -2,
    "fed up": -2,
    "disappointed": -2,
    "complaint": -2,
    "delays": -1,
    "confused": -1,
    "curious": 0,
}

# --- social-text normaliser --------------------------------------------------------------
SMILES = (":-)", ":)", ";-)", ";)", ":-d", ":d", "=)", "(-:", "(:")
SADS = (":-(", ":(", ";-(", ";(", ":'(", ")-:", "):", "t_t", "d-:")
CONTRACTIONS = (
    (r"\bcan't\b", "can not"),
    (r"\bwon't\b", "will not"),
    (r"n't\b", " not"),
    (r"'re\b", " are"),
    (r"'ve\b", " have"),
    (r"'ll\b", " will"),
    (r"'d\b", " would"),
    (r"'m\b", " am"),
    (r"'s\b", ""),
)
NEGATIONS = ("not", "no", "never", "none", "nobody", "nothing", "nowhere", "neither", "cannot")
NEGATION_WINDOW = 3
# fixed values: words that carry no content
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "did", "do",
    "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having",
    "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it",
    "its", "itself", "just", "like", "me", "more", "most", "my", "myself", "of", "off", "on", "once", "only",
    "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so",
    "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these",
    "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were",
    "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your", "yours",
    "yourself", "yourselves", "one", "also", "get", "got", "would", "could", "may", "might", "must", "shall",
    "us",
)

# --- labelled text ------------------------------------------------------------------------
SENTIMENTS = ("Negative", "Neutral", "Positive")

# --- model bake-off -------------------------------------------------------------------------
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
NB_ALPHAS = (0.1, 0.5, 1.0)
LOGREG_CS = (0.5, 1.0, 2.0, 4.0)
SVC_CS = (0.25, 0.5, 1.0, 2.0)
CLASS_WEIGHTS = (None, "balanced")
CHAR_NGRAMS = (3, 5)
MIN_DF = 2
TOPIC_MIN_DF = 5
TOPIC_MAX_DF = 0.9
LDA_ITERATIONS = 25
NMF_ITERATIONS = 300
CALIBRATION_FOLDS = 3

# --- live monitoring ---------------------------------------------------------------------------
DISPLAY_ZONE = "Asia/Kolkata"
LIVE_WINDOW_START = "2026-09-13 00:00:00"  # display zone, closed interval
LIVE_WINDOW_END = "2026-09-22 20:30:00"
ARC_SPLIT = "2026-09-20 00:00:00"
SPIKE_Z = 2.5
SHIFT_MIN_ROWS = 5
KINDS = {
    "social": ("mastodon", "xsynd", "y_manual", "x_manual"),
    "news": ("gnews", "gnews_hi", "bing", "gdelt"),
    "publisher": (
        "feed_thehindu_cricket",
        "feed_sportstar_cricket",
        "feed_ht_sports",
        "feed_espncricinfo",
    ),
}
TOPIC_KEYWORDS = (
    "asian games", "india women", "harmanpreet", "mandhana", "shafali", "trophy", "naqvi",
    "kabaddi", "sindhu", "hockey india", "asian games medal",
)
ENTITIES = {
    "Harmanpreet Kaur": "harmanpreet|हरमनप्रीत",
    "Smriti Mandhana": "mandhana|मंडाना",
    "Shafali Verma": "shafali|शफाली",
    "Jemimah Rodrigues": "jemimah",
    "Deepti Sharma": "deepti",
    "Richa Ghosh": "richa ghosh",
    "Sree Charani": "charani",
    "Renuka Singh": "renuka",
    "Sri Lanka (final opp.)": "sri lanka|श्रीलंका",
    "Bangladesh (SF opp.)": "bangladesh|बांग्लादेश|बांग्ला",
    "Trophy standoff": "trophy|naqvi|ट्रॉफी|नकवी",
    "BCCI": "bcci",
    "Sindhu (badminton)": "sindhu|सिंधु",
    "Kabaddi": "kabaddi|कबड्डी",
    "Hockey": "hockey|हॉकी",
    "Shooting": "shooting|air rifle|निशानेबाजी|elavenil|शूटिंग",
    "Asian Games (event)": "asian games|एशियाई खेल|एशियन गेम्स",
}
SNOWFLAKE_EPOCH_MS = 1288834974657
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122, names that are URLs

# --- answer texts of the named analyses ---------------------------------------------------
SAYS = {
    "ring_no": "DIFFUSE -- indistinguishable from random scatter, NOT a coordinated ring",
    "ring_yes": "CONCENTRATED -- attribution is warranted",
    "corr_no": "no material relationship",
    "corr_yes": "relationship worth modelling",
    "uniform_no": "field is NOT uniform -- the leader is genuinely ahead",
    "uniform_yes": "field is flat -- the leader is ahead only by noise",
    "gap": "DATA GAP -- not a platform, not eligible to win",
    "gap_h3": "DATA GAP -- excluded from the H3 answer",
    "platform": "labelled platform",
    "sig": "SIGNIFICANT at 5%",
    "not_sig_rank": "NOT significant at 5% -- the ranking is a coin toss",
    "not_sig_followers": "NOT significant at 5% -- follower count does not predict engagement here",
    "cohort_high": "HIGH (>= 25k followers)",
    "cohort_low": "LOW (< 25k followers)",
    "blanks_all": "every extra row in the loose reading is a missing like count",
    "blanks_not": "the two readings differ for a reason that is NOT missing data",
    "h1_reachable": "threshold is reachable -- empty result would be a bug",
    "h1_empty": "EMPTY BY ARITHMETIC -- no user reaches 2x, so H1 returning 0 rows is the answer",
    "ntile_agree": "the two definitions AGREE -- the answer is not an artefact of NTILE",
    "ntile_differ": "the definitions DISAGREE -- report the boundary as unstable",
}
