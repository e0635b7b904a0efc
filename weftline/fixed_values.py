"""Texts, word lists, tables and settings that decide the results.

Everything in this module is data that has to stay as it is for the request
tables and the published columns to come out right.  ``{name}`` marks a hole
filled from a column (see ``weftline.functions.text.render``).
"""

# --- Fixed values: default settings --------------------------------------------------

GENERAL_MACROTOPICS = 20
TARGET_MACROTOPICS = 20
GENERAL_TOPICS = 10
TARGET_TOPICS = 10
PROMPTS_PER_TOPIC = 3
BROAD_SCENARIOS = 30
DETAILED_SCENARIOS = 30
PROMPTS_PER_SCENARIO = 5
PROMPTS_PER_TEXT = 3
QA_WEIGHTING = 4
NUM_CONTEXTS = 10_000
FIRST_N_TOKENS = 1_000
REVISED_SHARE = 0.5
TRANSLATION_ROWS = 15_000
TRANSLATION_MAX_INPUT_TOKENS = 2_048
TRANSLATION_MAX_OUTPUT_TOKENS = 4_096
MIN_LENGTH_RATIO = 0.75
MAX_LENGTH_RATIO = 25.0
TEACHER_MAX_TOKENS = 2_048
TEACHER_TEMPERATURE = 1.0
TEACHER_CALLS = 64
TEACHER_THINK_START = "analysis"
TEACHER_THINK_END = "assistantfinal"
TRAIN_THINK_START = "<think>"
TRAIN_THINK_END = "</think>"

# --- Fixed values: word lists --------------------------------------------------------

GENERAL_SEED_TOPICS = [
    "daily life",
    "the world",
    "health",
    "practical skills",
    "arts and culture",
    "sciences",
    "social sciences",
    "humanities",
]

TARGET_SEED_TOPICS = [
    "{lang_name} speaking places",
    "{lang_name} speaking people",
    "{lang_name} culture",
    "{lang_name} language",
    "{lang_name} history",
    "{lang_name} society",
    "{lang_name} daily life",
    "{lang_name} health",
]

TASK_TYPES = ["translate", "summarize", "improve", "classify"]
QUESTION_TASK = "answer a question about"
BANNED_TOKENS = ["<image>", "<video>", "<audio>"]
SOURCE_ROLES = {"human": "user", "gpt": "assistant"}
SUBSETS = ["contextual", "scenario", "topic"]

# --- Fixed values: request texts -----------------------------------------------------

TOPIC_SYSTEM = """You are a topic generating assistant. Your topic names should be as concise as possible.
    Your output should only consist of a single JSON object within a JSON block (delimited by ```json and ```) which has one key, "topics", which is an array of topic strings.
    Do not include asterisks (*) anywhere within your JSON."""

TOPIC_REQUEST = """Write {n} topics, things, people, places, objects, concepts, themes, or anything else that encompass the main aspects of {macrotopic}.
    Your topics should be diverse, comprehensive, concise, and be written in simple English."""

TOPIC_LANGUAGE_CLAUSE = """

Your topics should be relevant to people who speak {lang_name}."""

TOPIC_PROMPT_REQUEST = """Write at least {min_n} and at most {n} {lang_name} {kind}s related to {topic}"""
TOPIC_PROMPT_ENDING = " that a user would ask an AI assistant."
TOPIC_PROBLEM_ENDING = "."

SCENARIO_SYSTEM = """You are a scenario generating assistant. Your scenario names should be as concise as possible.
    Your output should only consist of a single JSON object within a JSON block (delimited by ```json and ```) which has one key, "scenarios", which is an array of scenario strings."""

SCENARIO_SEEDED = "Write {n} specific practical scenarios that people would use an AI assistant for when they are using the assistant for the following task: {scenario}."
SCENARIO_UNSEEDED = "Write the {n} most popular scenarios that people would use an AI chatbot for."

SCENARIO_RULES = """
    
    Do not include asterisks (*) in any of your output.

    Your scenarios should be general and concise, rather than detailed.
    Your scenarios should be diverse, realistic, practical, comprehensive, concise, and be written in English."""

SCENARIO_LANGUAGE_CLAUSE = """

Consider the scenarios in which a {lang_name} speaker would use an AI assistant.
    Your scenarios should be specific to users who speak {lang_name}."""

SCENARIO_PROMPT_REQUEST = """Write {n} prompts in {lang_name} that a user would ask an AI chatbot when they are using the chatbot in the following scenario: {scenario}."""

CONTEXT_PROMPT_REQUEST = """Write {n} prompts in {lang_name} related to the following text:

    {text}

    The prompts should be written in natural {lang_name} and should ask the AI assistant to {prompt_type} the text."""

REVISION_REQUEST = """Prompt:
    
    {prompt}"""

REVISION_CONTEXT_REQUEST = """Context text:

    {text}
    
    Prompt:
    
    {prompt}"""

REVISION_CONTEXT_CLAUSE = "\n\nDo NOT output any of the given context text, only improve the given prompt. However, the prompt should still refer to the context text."

TRANSLATION_SYSTEM = """You are an English to {lang_name} translation assistant.
  Given a list of dicts that form a conversation in English between a user and assistant, output the {lang_name} translation of that conversation in the same list of dicts format.
  Only include this list of dicts in your final output.
  Keep the keys and format of the list of dicts the same in your translation.
"""

PROMPT_SYSTEM = """You are a {lang_name} speaking user of an AI assistant and you speak in natural {lang_name}.
Your goal is to write a list of prompts in {lang_name}.
The prompts should be diverse, practical, and realistic.
Be as natural and casual as a {lang_name} speaker would be when speaking to a {lang_name} AI assistant.
Do not refer to the assistant directly - be simple where possible.
Use colloquialisms and informal or casual {lang_name} where appropriate to make your prompts as natural and realistic as possible.
Your output should only consist of a single JSON object within a JSON block (delimited by ```json and ```) which has one key, "prompts", which is an array of the {lang_name} prompts.
"""

REVISION_SYSTEM = """You are a prompt improvement assistant. Given a prompt in {lang_name}, revise it to make it better.
Your can do any of the following:
* Make the language of the prompt more natural and casual, like how a {lang_name} would actually talk to a helpful assistant.
* Add some context to the original prompt. The context might state the importance of the prompt, explain background knowledge, or add other reasonable information.
* Change the prompt into a different format or style. For example: imperative statements (i.e. adding stipulations for how or how not to output the response), length requirements for the answer (e.g. answer in a single phrase, answer in k words etc.), requiring output in a certain format.
* Elongate prompts that require to elaborate on specific topic or discuss a certain point.
* Add other related questions, statements, or instructions.
Your output should only consist of a single JSON object within a JSON block (delimited by ```json and ```) which has one key, "improved_prompt", which is a string of the improved prompt written in {lang_name}.
"""

ANSWER_SYSTEM = """You are a helpful chatbot assistant that speaks in fluent {lang_name}.
Your response should be fully understandable to a {lang_name} speaker.
Speak like a native {lang_name} speaker to the user unless prompted otherwise.
If you give information, always give only correct information.
If you are given instructions, always follow the instructions correctly and fully.
Your response should have minimal formatting where possible - avoid overly complex lists, emphasis, or Markdown formatting unless specified by the user.
If prompted to output a URL, say that you cannot output URLs directly but you can advise ways to find the correct URL (e.g. by suggesting web search terms).
Write your response in as simple and as conversational a tone as possible.
Do not include URLs in your output as they may be hallucinated.
Finally, your responses should be as short as possible - respond with the least words while answering the user's prompt.
"""

REASONING_SYSTEM = "Before you respond, first think about your response and enclose your thinking process in {start} and {end} delimiters."
TRANSLATED_SYSTEM = "Be concise in your responses."

# --- Fixed values: language codes, in table order ------------------------------------
# The script-code table (about 240 rows) is not kept here: it is a parameter, read with
# ``weftline.operators.langs.read_codes`` from a file with columns ord, code, name.

TWO_LETTER_CODES = [
    ("am", "Amharic"),
    ("ar", "Arabic"),
    ("as", "Assamese"),
    ("bn", "Bengali"),
    ("cs", "Czech"),
    ("da", "Danish"),
    ("de", "German"),
    ("el", "Greek"),
    ("en", "English"),
    ("es", "Spanish"),
    ("fa", "Persian"),
    ("fi", "Finnish"),
    ("fil", "Filipino"),
    ("fr", "French"),
    ("gu", "Gujarati"),
    ("ha", "Hausa"),
    ("he", "Hebrew"),
    ("hi", "Hindi"),
    ("hu", "Hungarian"),
    ("id", "Indonesian"),
    ("ig", "Igbo"),
    ("it", "Italian"),
    ("ja", "Japanese"),
    ("km", "Khmer"),
    ("kn", "Kannada"),
    ("ko", "Korean"),
    ("ky", "Kyrgyz"),
    ("lt", "Lithuanian"),
    ("mg", "Malagasy"),
    ("ml", "Malayalam"),
    ("mr", "Marathi"),
    ("ms", "Malay"),
    ("my", "Burmese"),
    ("ne", "Nepali"),
    ("nl", "Dutch"),
    ("no", "Norwegian"),
    ("ny", "Chichewa"),
    ("or", "Oriya"),
    ("pa", "Punjabi"),
    ("pl", "Polish"),
    ("pt", "Portuguese"),
    ("ro", "Romanian"),
    ("ru", "Russian"),
    ("si", "Sinhala"),
    ("sn", "Shona"),
    ("so", "Somali"),
    ("sr", "Serbian"),
    ("sv", "Swedish"),
    ("sw", "Swahili"),
    ("ta", "Tamil"),
    ("te", "Telugu"),
    ("th", "Thai"),
    ("tr", "Turkish"),
    ("uk", "Ukrainian"),
    ("vi", "Vietnamese"),
    ("yo", "Yoruba"),
    ("zh", "Simplified Chinese"),
    ("zh_cn", "Simplified Chinese"),
    ("zh_hk", "Hong Kong Chinese"),
    ("zh_tw", "Traditional Chinese"),
]

THREE_LETTER_CODES = [
    ("afr", "Afrikaans"),
    ("amh", "Amharic"),
    ("ara", "Arabic"),
    ("asm", "Assamese"),
    ("aym", "Aymara"),
    ("aze", "Azerbaijani"),
    ("bem", "Bemba"),
    ("ben", "Bengali"),
    ("bod", "Tibetan"),
    ("bos", "Bosnian"),
    ("bul", "Bulgarian"),
    ("cat", "Catalan"),
    ("ces", "Czech"),
    ("cym", "Welsh"),
    ("deu", "German"),
    ("ell", "Greek"),
    ("eng", "English"),
    ("epo", "Esperanto"),
    ("ewe", "Ewe"),
    ("fas", "Persian"),
    ("fil", "Filipino"),
    ("fon", "Fon"),
    ("fra", "French"),
    ("gla", "Scottish Gaelic"),
    ("gle", "Irish"),
    ("guj", "Gujarati"),
    ("hat", "Haitian Creole"),
    ("hau", "Hausa"),
    ("heb", "Hebrew"),
    ("hin", "Hindi"),
    ("hrv", "Croatian"),
    ("hun", "Hungarian"),
    ("hye", "Armenian"),
    ("ibo", "Igbo"),
    ("ind", "Indonesian"),
    ("isl", "Icelandic"),
    ("ita", "Italian"),
    ("jpn", "Japanese"),
    ("kan", "Kannada"),
    ("kat", "Georgian"),
    ("khm", "Khmer"),
    ("kin", "Kinyarwanda"),
    ("kir", "Kirghiz"),
    ("kor", "Korean"),
    ("kur", "Kurdish"),
    ("lao", "Lao"),
    ("lav", "Latvian"),
    ("lin", "Lingala"),
    ("lit", "Lithuanian"),
    ("lug", "Luganda"),
    ("mal", "Malayalam"),
    ("mar", "Marathi"),
    ("mkd", "Macedonian"),
    ("mlg", "Malagasy"),
    ("mon", "Mongolian"),
    ("mya", "Burmese"),
    ("nde", "North Ndebele"),
    ("nep", "Nepali"),
    ("nld", "Dutch"),
    ("ori", "Oriya"),
    ("orm", "Oromo"),
    ("pan", "Panjabi"),
    ("pol", "Polish"),
    ("por", "Portuguese"),
    ("prs", "Dari"),
    ("pus", "Pushto"),
    ("ron", "Romanian"),
    ("run", "Rundi"),
    ("rus", "Russian"),
    ("sin", "Sinhala"),
    ("slk", "Slovak"),
    ("slv", "Slovenian"),
    ("sna", "Shona"),
    ("som", "Somali"),
    ("sot", "Sotho"),
    ("spa", "Spanish"),
    ("sqi", "Albanian"),
    ("srp", "Serbian"),
    ("swa", "Swahili"),
    ("swe", "Swedish"),
    ("tam", "Tamil"),
    ("tel", "Telugu"),
    ("tgk", "Tajik"),
    ("tha", "Thai"),
    ("tir", "Tigrinya"),
    ("tur", "Turkish"),
    ("twi", "Twi"),
    ("ukr", "Ukrainian"),
    ("urd", "Urdu"),
    ("uzb", "Uzbek"),
    ("vai", "Vai"),
    ("vie", "Vietnamese"),
    ("wol", "Wolof"),
    ("xho", "Xhosa"),
    ("yor", "Yoruba"),
    ("yue", "Yue Chinese"),
    ("zho", "Chinese"),
    ("zul", "Zulu"),
]
