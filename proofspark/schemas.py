"""Explicit schemas; nothing is inferred."""

CANDIDATE = (
    "struct<category:string,grammar_subtype:string,quote:string,context_before:string,context_after:string,"
    "reason:string,suggestion:string,confidence:int,evidence_source_ids:array<string>>"
)
VERDICT = (
    "struct<candidate_index:int,category:string,grammar_subtype:string,verdict:string,confidence:int,"
    "reason:string,suggestion:string,evidence_source_ids:array<string>>"
)
EVIDENCE_REF = "struct<source_id:string,title:string,revision:string,source_url:string>"
LOCATION = (
    "struct<document_format:string,page:int,page_end:int,line_start:int,line_end:int,paragraph_index:int,"
    "sentence_index:int,char_start:int,char_end:int,quote:string>"
)
RULES = (
    "rule_no int, needle string, category string, grammar_subtype string, quote string, context_before string, "
    "context_after string, reason string, suggestion string, confidence int, evidence_source_ids array<string>"
)
ISSUE = (
    f"struct<id:string,category:string,grammar_subtype:string,level:string,location:{LOCATION},"
    f"original_text:string,reason:string,suggestion:string,confidence:int,evidence_refs:array<{EVIDENCE_REF}>,"
    "feedback:string>"
)
SUMMARY = (
    "struct<total:int,confirmed:int,suspected:int,typo:int,punctuation:int,grammar:int,paragraph:int>"
)
MISS = (
    "struct<id:string,category:string,char_start:int,char_end:int,quote:string,note:string,created_at:string>"
)
REPORT = (
    "schema string, report_id string, job_id string, "
    "document struct<original_name:string,format:string,char_count:int>, "
    "analysis struct<analysis_profile:string,provider_kind:string,candidate_model:string,verifier_model:string,"
    "prompt_version:string,reference_version:string,analyzer_version:string,reference_profile:boolean>, "
    f"summary {SUMMARY}, issues array<{ISSUE}>, missed_issues array<{MISS}>, complete boolean, generated_at string"
)
GOLD = (
    "document_id string, issues array<struct<category:string,grammar_subtype:string,char_start:int,char_end:int>>"
)
STATUS_EVENT = (
    "job_id bigint, user_id bigint, ts timestamp, status string, stage string, progress int, "
    "completed_chunks int, worker_id string"
)
