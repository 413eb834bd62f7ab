"""Word lists and wordings of conversation analysis."""

# fixed values: scores of words, words that turn the next around
POSITIVE = {
    "good": 1.0, "great": 1.5, "awesome": 2.0, "excellent": 2.0, "perfect": 1.8, "love": 1.8, "like": 0.4, "nice": 1.2, "cool": 1.2, "happy": 1.5, "glad": 1.3,
    "thanks": 1.0, "thank": 1.0, "agree": 1.2, "agreed": 1.2, "yes": 0.6, "yeah": 0.4, "sure": 0.5, "definitely": 1.0, "absolutely": 1.3, "right": 0.4,
    "better": 0.9, "best": 1.4, "strong": 0.9, "smart": 1.2, "helpful": 1.2, "interesting": 0.8, "fantastic": 2.0, "wonderful": 1.8, "sweet": 1.0,
    "appreciate": 1.4, "exciting": 1.5, "excited": 1.5, "impressive": 1.5,
}
NEGATIVE = {
    "bad": -1.3, "wrong": -1.2, "hard": -0.7, "difficult": -1.0, "problem": -1.2, "issue": -0.9, "concern": -1.0, "concerned": -1.1, "worry": -1.2,
    "worried": -1.2, "unfortunately": -1.3, "fail": -1.6, "failed": -1.6, "weak": -1.1, "worse": -1.3, "worst": -1.8, "confusing": -1.1,
    "confused": -1.1, "unclear": -0.9, "disappointing": -1.6, "sorry": -0.6, "no": -0.5, "not": -0.4, "never": -0.7, "cannot": -0.6, "stuck": -1.1,
    "annoying": -1.4, "frustrating": -1.5, "frustrated": -1.5, "risk": -0.7,
}
NEGATORS = ("not", "no", "never", "cannot", "don't", "doesn't", "didn't", "isn't", "wasn't", "won't", "can't", "nothing")

# fixed values: hedges
HEDGES = ("kind of", "sort of", "maybe", "I guess", "I think", "probably", "a little", "just")

# fixed values: filled pauses of word classes and vocalisations
FILLERS = ("um", "uh", "uhm", "umm", "uhh", "erm", "er", "ehm", "em")
VOCALISATIONS = ("hmm", "hm", "mm", "mhm", "mmm", "mm-hmm", "uh-huh", "mhmm")

# fixed values: wording that a claim must not have
BANNED = r"(?i)\b(?:lying|liar|liars|lie|lies|lied|deceptive|deceiving|deceitful|dishonest|hiding|concealing|manipulative)\b|evasive\s+person"

# fixed values: what is said of a feature above and below its usual level, in this order; null: nothing
NOTES = (
    ("articulation", "faster than usual", "slower than usual"),
    ("arousal", "more energy than usual", "less energy than usual"),
    ("f0_range", "pitch unusually varied", "pitch unusually flat"),
    ("loudness_sd", "more emphasis than usual", "unusually even delivery"),
    ("terminal_rise", "ends higher than usual", "ends lower than usual"),
    ("certainty", None, "sounds less certain than usual"),
    ("medial_fillers", "more mid-sentence hesitation than usual", None),
)

# fixed values: how a name is introduced and addressed, and capitalised words that are no names
NAME = r"([A-Z][a-z]+(?:-[A-Z][a-z]+)?)"
OPENING = r"\b(?:I'?m|I am|my name is|my name'?s|this is)\s+" + NAME + r"\b"
ADDRESSES = (
    r"\b(?:hi|hey|hello|thanks|thank you|bye|goodbye|yes|no|okay|sorry|right|sure|exactly|welcome|morning|afternoon)[,!]?\s+" + NAME + r"\b[,.!?]",
    r",\s+" + NAME + r"[.!?]",
)
NOT_NAMES = (
    "i", "ok", "okay", "yeah", "yes", "no", "right", "well", "so", "and", "but", "oh", "um", "uh", "hi", "hey", "hello", "bye", "thanks", "thank",
    "sorry", "cool", "great", "good", "perfect", "awesome", "sure", "wait", "actually", "anyway", "alright", "exactly", "absolutely", "honestly",
    "look", "listen", "man", "guys", "everyone", "everybody", "team", "sir", "madam", "buddy", "dude", "god", "jesus", "christ", "monday", "tuesday",
    "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december", "zoom", "google", "teams", "meet", "gotcha", "correct", "true", "interesting", "nice",
    "morning", "afternoon", "evening", "night", "today", "tomorrow", "yesterday", "please", "welcome", "cheers", "later", "now", "one",
    "two", "three", "what", "who", "why", "how", "where", "when", "like", "so", "see", "look", "say", "know", "mean", "guess", "then",
    "also", "maybe", "basically", "obviously", "literally", "totally", "definitely", "probably", "again", "though", "still", "fine", "done",
    "wow", "huh", "yep", "nope", "come", "go", "stop", "hold", "hang", "first", "second", "next", "last", "plus", "minus", "anyways",
)
