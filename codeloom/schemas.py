"""Schemas of the stored tables and of the records that stages pass on, as DDL."""

from __future__ import annotations

USERS = """id string, email string, name string, photo_url string, phone string, auth_provider string, created_at timestamp_ntz,
updated_at timestamp_ntz, email_reports boolean, risk_threshold string, theme string"""

CONNECTIONS = """id string, user_id string, github_username string, github_user_id string, access_token string, avatar_url string,
connected_at timestamp_ntz, is_primary boolean"""

ANALYSES = """id string, user_id string, created_at timestamp_ntz, completed_at timestamp_ntz, input_mode string, source_name string,
github_repo string, github_connection_id string, status string, error_message string, language string, era string,
language_breakdown map<string,int>, total_files int, total_issues int, security_issues int, overall_risk string, minimality_score double,
complexity_before double, complexity_after double, confidence_score double, estimated_hours_saved double, tests_passed boolean,
test_count int, full_report string, report_markdown string"""

CHANGES = """id string, analysis_id string, file_path string, issue_type string, description string, old_code string, new_code string,
line_start int, line_end int, risk_level string, risk_reason string, confidence double, priority int, callers int, status string"""

FILES = "analysis_id string, file_idx int, path string, content string"

ISSUE = """struct<issue_type:string,description:string,affected_lines:array<int>,priority:int,estimated_impact:string,
modernization_hint:string,safe_to_auto_fix:boolean>"""

EDIT = "struct<ord:int,issue_type:string,old_code:string,new_code:string,line_start:int,line_end:int,reason:string,status:string>"

FUNCTION = """struct<name:string,start_line:int,end_line:int,class:string,calls:array<string>,complexity:int,is_public:boolean,
decorators:array<string>,has_io:boolean,io_types:array<string>,lines_of_code:int>"""

CLASS = "struct<name:string,start_line:int,end_line:int,methods:array<string>,method_count:int,is_public:boolean,decorators:array<string>,lines_of_code:int>"

IMPORT = "struct<module:string,alias:string,line:int,import_type:string,names:array<string>,raw:string>"

PARSED = f"""struct<functions:array<{FUNCTION}>,classes:array<{CLASS}>,imports:array<{IMPORT}>,has_parse_errors:boolean,error_node_count:int,
raw_ast_node_count:int,fallback_mode:boolean>"""

FINDING = "struct<tool:string,severity:string,confidence:string,line:int,issue:string,test_id:string,cwe:string>"

TRACE = "analysis_id string, type string, layer string, status string, duration_ms bigint, ts timestamp, file string, seq bigint"
