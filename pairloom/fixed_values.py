"""Fixed values.

Everything in this module is a given: word lists, templates, bounds and patterns
that results depend on literally. Operators take them as default arguments, so
any of them can be replaced by the caller.
"""

# --- fixed values: keyword gate ------------------------------------------------
TECH_KEYWORDS = [
    'software', 'engineer', 'developer', 'programming', 'python', 'java',
    'javascript', 'machine learning', 'ai', 'computer science',
    'backend', 'frontend', 'fullstack', 'devops', 'cloud', 'aws', 'azure',
    'algorithm', 'database', 'sql', 'api', 'ios', 'android',
    'react', 'node', 'vue', 'docker', 'kubernetes', 'git',
    'agile', 'scrum', 'ci/cd', 'microservices', 'system design', 'architecture', 'embedded', 'firmware',
    'robotics', 'automation', 'ml', 'deep learning', 'nlp', 'computer vision',
    'data science', 'big data', 'hadoop', 'spark', 'tensorflow',
    'pytorch', 'scala', 'rust', 'c++', 'c#', '.net', 'ruby'
]
LEFT_MIN_HITS = 8
RIGHT_MIN_HITS = 3
CLEAN_MIN_CHARS = 100

# --- fixed values: matching ----------------------------------------------------
MAX_FEATURES = 1000
MIN_DF = 2
PAIRS_PER_LEFT = 100
TARGET_PAIRS = 10000
SEED = 42

# English stop words of Spark's StopWordsRemover, without the contractions, which
# a token of word characters can never equal.
ENGLISH_STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him "
    "his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing an the and but if or because "
    "as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very can will just "
    "don should now cannot could ought would"
).split()

# --- fixed values: requests and responses --------------------------------------
BATCH_SIZE = 100
TEMPERATURE = 0.7
MAX_OUTPUT_TOKENS = 8000
MIN_OUTPUT_CHARS = 100
NOT_SPECIFIED = "Not specified"

# Doubled braces are not used: fields are written {name} and filled by render().
TEACHER_TEMPLATE = """You are an expert resume writer and career coach. Your task is to tailor a resume and write a cover letter for a specific job application.

ORIGINAL RESUME:
{resume_text}

JOB POSTING:
Title: {job_title}
Description: {job_description}
Required Skills: {job_skills}

INSTRUCTIONS:
1. Create a TAILORED RESUME that:
   - Emphasizes skills and experiences most relevant to the job
   - Uses keywords from the job description naturally
   - Maintains same general structure as original
   - ONLY includes information from original resume (NO hallucinations)
   - Keeps same level of detail but reorders/rephrases for relevance

2. Write a COVER LETTER that:
   - Is professional and compelling (250-350 words)
   - Connects the candidate's background to this specific role
   - Shows genuine interest in the position and company
   - Uses a professional yet personable tone
   - ONLY references experiences from the resume (NO fabrications)

OUTPUT FORMAT - STRICT JSON ONLY:
{
    "tailored_resume": "PUT ENTIRE RESUME HERE AS SINGLE LINE WITH \\n FOR NEWLINES",
    "cover_letter": "PUT ENTIRE COVER LETTER HERE AS SINGLE LINE WITH \\n FOR NEWLINES"
}

CRITICAL RULES:
- Output ONLY the JSON object, nothing else
- Use \\n for line breaks, not actual newlines
- Escape all quotes inside strings with \\"
- No text before or after the JSON
"""

# --- fixed values: quality filter ----------------------------------------------
REQUIRED_FIELDS = ['original_resume', 'job_title', 'job_description',
                   'tailored_resume', 'cover_letter']
# (column, least, most, name used in the message), in checking order
LENGTH_BOUNDS = [
    ('original_resume', 200, 20000, 'Original resume'),
    ('tailored_resume', 200, 20000, 'Tailored resume'),
    ('cover_letter', 200, 3000, 'Cover letter'),
    ('job_description', 100, 15000, 'Job description'),
]
NOVELTY_LIMIT = 0.3
NOVELTY_STOP_WORDS = ['that', 'this', 'with', 'have', 'from', 'your',
                      'they', 'been', 'will', 'their', 'were', 'what',
                      'about', 'would', 'there', 'which', 'when', 'make']
MIN_PARAGRAPHS = 2
MENTION_WORDS = ['position', 'role', 'opportunity', 'job', 'team']
STRUCTURE_MESSAGE = "Cover letter lacks structure (too few paragraphs)"
MENTION_MESSAGE = "Cover letter doesn't mention position/role"

# --- fixed values: training and inference text ----------------------------------
TRAINING_TEMPLATE = """You are an expert resume writer. Tailor this resume for the job posting and write a cover letter.

RESUME:
{original_resume}

JOB POSTING:
Title: {job_title}
Description: {job_description}
Skills: {job_skills}

Generate a tailored resume and cover letter for this application."""

COMPLETION_TEMPLATE = """TAILORED RESUME:
{tailored_resume}

COVER LETTER:
{cover_letter}"""

CHAT_TEMPLATE = "<|user|>\n{instruction}<|end|>\n<|assistant|>\n{output}<|end|>"
CHAT_OPENING = "<|user|>\n{instruction}<|end|>\n<|assistant|>\n"
RESUME_MARKER = "TAILORED RESUME:"
LETTER_MARKER = "COVER LETTER:"
SPLIT_RATIOS = (0.8, 0.1, 0.1)
CHARS_PER_TOKEN = 4

# --- fixed values: evaluation ---------------------------------------------------
OVERLAP_STOP_WORDS = ['that', 'this', 'with', 'have', 'from', 'your',
                      'been', 'will', 'their', 'were', 'what', 'about',
                      'would', 'there', 'which', 'when', 'make', 'more']
BLEU_MAX_ORDER = 4
