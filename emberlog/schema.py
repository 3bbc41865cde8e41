"""Row types: nested, with every field nullable."""

FAILURE = "struct<task:string,package:string,recipe:string,log:string,kind:string>"
LINE = "struct<n:int,level:string,text:string>"
FRAME = "struct<index:int,func:string,path:string,line:int>"
#: What a rule makes of a failure.
HIT = (
    "struct<category:string,severity:string,title:string,recipe:string,task:string,"
    "file:string,line:int,evidence:array<string>,confidence:double>"
)
BUILD_FIELDS = ("component", "machine", "distro", "build_sys", "target_sys", "bitbake_version", "branch_commit")
RUN_FINDING = "struct<signature:string,category:string,severity:string,recipe:string,title:string>"
RUN = (
    "run_ord bigint, run_id string, recorded_at string, tool_version string, source_count int, "
    f"findings array<{RUN_FINDING}>, summary struct<errors:bigint,warnings:bigint,by_category:map<string,bigint>>"
)
SUMMARY = "summary struct<errors:bigint,warnings:bigint,by_category:map<string,bigint>>"
RUN_HEAD = f"run_ord bigint, run_id string, recorded_at string, tool_version string, source_count int, {SUMMARY}"
RUN_ROW = "run_ord bigint, run_id string, recorded_at string, place bigint, signature string, category string, severity string, recipe string, title string"
