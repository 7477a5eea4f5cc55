"""Declared schemas; nothing is inferred."""

RESUMES_RAW = "ID bigint, Resume_str string, Category string"
RESUMES_CLEAN = "ID bigint, Resume_str string"
JOBS = (
    "job_id bigint, title string, description string, company_name string, "
    "location string, skills_desc string, formatted_experience_level string"
)
PAIRS = "resume_id bigint, job_id bigint, similarity_score double"
FULL_PAIRS = (
    "resume_id bigint, job_id bigint, similarity_score double, resume_text string, "
    "job_title string, job_description string, job_skills string, company_name string, "
    "location string, experience_level string"
)
REQUEST = (
    "key string, request struct<contents: array<struct<parts: array<struct<text: string>>, "
    "role: string>>, generation_config: struct<temperature: double, max_output_tokens: int>>"
)
RESPONSE_BODY = (
    "struct<candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>, "
    "text: string>"
)
RESPONSE = f"key string, response {RESPONSE_BODY}"
GENERATED = (
    "resume_id bigint, job_id bigint, similarity_score double, original_resume string, "
    "job_title string, job_description string, job_skills string, tailored_resume string, "
    "cover_letter string, timestamp timestamp"
)
METADATA = "struct<resume_id: bigint, job_id: bigint, similarity_score: double>"
INSTRUCTION = f"instruction string, output string, metadata {METADATA}"
CHAT = f"messages array<struct<role: string, content: string>>, metadata {METADATA}"
RESULT = (
    "resume_id bigint, job_id bigint, original_resume string, job_title string, "
    "job_description string, tailored_resume string, cover_letter string, "
    "ground_truth_resume string, ground_truth_cover_letter string"
)
