"""Closed vocabularies and limits that results depend on."""

from __future__ import annotations

# Fixed values.
FILLERS = ("uh", "um", "erm", "hmm", "mm", "ah")

# Fixed values.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "rev", "gen",
    "fig", "eq", "no", "nos", "approx", "dept", "inc", "vs", "etc", "e.g", "i.e",
)

# Fixed values.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}

# Fixed values.
SUPPORT_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "because", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "here", "him", "his",
    "i", "if", "in", "is", "it", "its", "of", "on", "or", "our", "she", "so", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those",
    "to", "was", "we", "were", "which", "who", "will", "with", "you", "your",
)

#: Words that never identify a term. Callers with a larger list pass their own.
GENERIC_WORDS = (
    *SUPPORT_STOPWORDS, "about", "after", "all", "also", "any", "before", "both", "can", "could", "did", "do", "does", "each", "even", "every", "get", "give", "go", "how",
    "into", "just", "know", "like", "look", "make", "many", "may", "more", "most", "much", "must", "need", "new", "not", "now", "off", "one", "only", "other", "out", "over",
    "part", "same", "say", "see", "should", "some", "such", "take", "than", "thing", "think", "time", "too", "two", "under", "until", "use", "very", "want", "way", "well",
    "what", "when", "where", "while", "why", "within", "without", "would", "yes", "yet",
)

# Words that say too little to support an edit.
EDIT_GENERIC = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "here", "him", "how",
    "i", "if", "in", "into", "is", "it", "its", "just", "like", "look", "may", "me", "more", "most", "my", "no", "not", "of", "on", "one", "only", "or", "our", "out",
    "right", "said", "say", "says", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to",
    "up", "us", "use", "used", "uses", "using", "very", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
)

# Openings of a new topic.
TRANSITION_CUES = (
    "now", "next", "next,", "however", "on the other hand", "in contrast", "therefore", "so", "as a result", "moving on", "let's move on", "let’s move on", "finally",
    "to summarize", "in summary", "the next topic", "the next part", "another point", "another thing", "another important point", "another important thing", "by contrast",
)

# Stages of a transcript and the models that each prefers, best first.
STAGES = ("provisional", "revised", "highQuality")
STAGE_PREFERENCES = {
    "provisional": ("base", "tiny", "small", "medium", "turbo", "large"),
    "revised": ("turbo", "medium", "large", "small", "base", "tiny"),
    "highQuality": ("large", "turbo", "medium", "small", "base", "tiny"),
}

# What each artifact is made from, and what a change of materials touches.
DEPENDENCIES = (
    ("cleanedTranscript", "rawTranscript"), ("rawTranslation", "rawTranscript"), ("translation", "cleanedTranscript"), ("cleanedTranslation", "cleanedTranscript"),
    ("keyPoints", "cleanedTranscript"), ("qa", "cleanedTranscript"), ("structuredAnalysis", "cleanedTranscript"), ("notes", "cleanedTranscript"), ("outline", "cleanedTranscript"),
    ("notesTranslation", "notes"), ("outlineTranslation", "outline"),
)
MATERIAL_ROOTS = ("cleanedTranscript", "notes", "outline")
