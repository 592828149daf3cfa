"""They must equal the published ones for results to match."""

# Label orders. Reward vectors and scorer vectors use different orders.
REWARD_ORDER = ("negative", "neutral", "positive")
SCORER_ORDER = ("positive", "negative", "neutral")
LABELS = REWARD_ORDER

# Sizes and seeds of the experiment.
TRAIN_PER_CLASS = 300
TEST_PER_CLASS = 300
EVAL_PER_CLASS = 50
SPLIT_SEED = 42
SHUFFLE_SEED = 10
EVAL_SEED = 10

# Thresholds.
SIM_THRESHOLD = 0.85
LENGTH_RATIO = 0.5
NOTEBOOK_LENGTH_RATIO = 0.2
PARAPHRASE_LENGTH_DELTA = 0.20
MARGIN_DROP = 0.2
SYNONYM_RATIO = 0.25
READABLE_CHARS = 80

# Numeric guards.
PROB_FLOOR = 1e-12
METRIC_FLOOR = 1e-8
STD_FLOOR = 1e-8
EMPTY_LABEL_SCORE = -1e9

# Reward weights: ground truth, teacher, consistency, anchor KL.
W_GT, W_TEACHER, W_CONSISTENCY, W_ANCHOR = 0.0, 0.3, 0.3, 0.2
# Reward weights of the prototype: consistency, alignment, calibration.
W_PROTO_CONS, W_PROTO_ALIGN, W_PROTO_CALIB = 1.0, 0.5, 0.01

# Policy-step constants of the prototype.
EMA_DECAY = 0.9
CLIP_EPS = 0.1
KL_COEF = 0.01
REPORT_EVERY = 10

# Prompt template.
PROMPT_HEAD = (
    "Analyze the sentiment of the news headline enclosed in square brackets, \n"
    "            determine if it is positive, neutral, or negative, and return the answer as \n"
    '            the corresponding sentiment label "positive" or "neutral" or "negative".\n'
    "\n"
    "            ["
)
CHAT_INSTRUCTION = (
    "Classify the sentiment of the following text into negative, neutral, or positive.\n"
)

# Company name -> peer name, in matching order.
SECTOR_PEERS = [
    ("Barclays", "Citigroup"),
    ("Citigroup", "Goldman Sachs"),
    ("Goldman Sachs", "Deutsche Bank"),
    ("Deutsche Bank", "Credit Suisse"),
    ("Credit Suisse", "JPMorgan"),
    ("JPMorgan", "UBS"),
    ("UBS", "Bank of America"),
    ("Bank of America", "Morgan Stanley"),
    ("Morgan Stanley", "Barclays"),
    ("United", "American Airlines"),
    ("American Airlines", "British Airways"),
    ("British Airways", "Delta"),
    ("Delta", "Emirates"),
    ("Emirates", "United"),
    ("Orange", "China Mobile"),
    ("China Mobile", "Verizon"),
    ("Verizon", "Vodafone"),
    ("Vodafone", "AT&T"),
    ("AT&T", "Orange"),
    ("Target", "CVS"),
    ("CVS", "Home Depot"),
    ("Home Depot", "Target"),
    ("Microsoft", "Google"),
    ("Google", "Apple"),
    ("Apple", "Intel"),
    ("Intel", "IBM"),
    ("IBM", "Qualcomm"),
    ("Qualcomm", "Microsoft"),
    ("BP", "Shell"),
    ("Shell", "BP"),
    ("Volkswagen", "Ford"),
    ("Ford", "Honda"),
    ("Honda", "Volkswagen"),
    ("Sony", "Fox"),
    ("Fox", "Sony"),
    ("X", "Snap"),
]

# Entity types that take part in the entity filter.
ENTITY_TYPES = ("GPE", "MONEY", "ORG", "PERCENT", "PRODUCT")

# Paraphrase rules, applied in this order. "{adv}" is the softening adverb.
SOFTENING_ADVERB = "slightly"
PARAPHRASE_RULES = [
    (r"\bbeat expectations\b", "exceeded expectations"),
    (r"\boutperformed expectations\b", "exceeded expectations"),
    (r"\bmissed expectations\b", "failed to meet expectations"),
    (r"\bfell short of expectations\b", "failed to meet expectations"),
    (r"\bmet expectations\b", "matched expectations"),
    (r"\babove guidance\b", "above its guidance"),
    (r"\bbelow guidance\b", "below its guidance"),
    (r"\bstrong demand\b", "robust demand"),
    (r"\bweak demand\b", "subdued demand"),
    (r"\b(sharply|dramatically|significantly|substantially|considerably)\b", "moderately"),
    (r"\b(soared|surged|skyrocketed)\b", "jumped"),
    (r"\b(plunged|tumbled|cratered)\b", "fell"),
    (r"\b(rose|increased|climbed|gained|advanced)\b", r"\1 {adv}"),
    (r"\b(fell|declined|dropped|slid|weakened)\b", r"\1 {adv}"),
    (r"\bThe company reported\b", "A report from the company indicated"),
    (r"\bThe firm reported\b", "A report from the firm indicated"),
    (r"\brevenues? (rose|increased)\b", r"revenue \1"),
    (r"\bprofits? (fell|declined)\b", r"profit \1"),
    (r"\bwas up\b", "rose"),
    (r"\bwas down\b", "declined"),
]

# Lemma -> synonyms of the dictionary-based replacement.
SYNONYM_DICT = {
    "rise": ["increase", "climb", "advance"],
    "fall": ["decline", "drop", "slide", "dip"],
    "strong": ["robust", "solid", "firm"],
    "weak": ["soft", "fragile", "subdued"],
}

# Words tried per label when class scores are read from token scores.
VERBALIZER_SEEDS = {
    "negative": [" negative", " bearish", " down", " slump", " plunge", " drop", " fall",
                 " miss", " lower", " downgrade", " warn", " loss", " decline", " weak",
                 " soften"],
    "neutral": [" neutral", " unchanged", " flat", " steady", " stable", " mixed", " inline",
                " rangebound", " muted", " sideways"],
    "positive": [" positive", " bullish", " up", " rally", " surge", " jump", " soar", " beat",
                 " raise", " upgrade", " profit", " growth", " expand", " strong",
                 " outperform"],
}
VERBALIZER_DEFAULT_WORD = " positive"
MAX_VARIANTS = 6

# Tokens treated as stop words besides an English stop list.
EXTRA_STOP_WORDS = ["!", ",", ".", "?", "-s", "-ly", "</s>", "s"]
