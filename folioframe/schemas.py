"""Schemas of the mail and ledger tables."""

from pyspark.sql.types import StructType

META = "struct<from_name:string,from_addr:string,date:string,date_raw:string,subject:string>"
DDL = {
    "emails": f"message_id string, in_reply_to string, refs array<string>, from_addr string, from_name string, to_addrs array<string>, cc_addrs array<string>, to_named array<struct<name:string,addr:string>>, sent_at timestamp, sent_tz string, subject string, new_text string, quoted_text string, fwd_text string, fwd_meta {META}, body_raw string, attachment_names array<string>, source_file string",
    "people": "id bigint, canonical_name string, role_guess string, org string, is_internal boolean",
    "identities": "person_id bigint, kind string, value string",
    "threads": "thread_id string, subject_norm string, first_at timestamp, last_at timestamp, n_msgs bigint, participants array<string>",
    "triage": "thread_id string, message_id string, signal string, note string",
    "thread_triage": "thread_id string, has_candidate boolean",
    "records": "record_id string, thread_id string, topic_label string, decision_text string, stance string, decision_type string, decided_by array<string>, decision_date string, rationale string, alternatives array<string>, conditions string, overrides_hint string, authority_note string, confidence double, cluster_id string",
    "evidence": "id bigint, owner_kind string, owner_id string, message_id string, quote string, role string, verified boolean",
    "clusters": "cluster_id string, topic string, summary string, current_state string, n_records bigint",
    "decisions": "decision_id string, cluster_id string, canonical_text string, decided_by array<string>, decided_at string, rationale string, alternatives array<string>, decision_type string, status string, authority_flag boolean, authority_note string, confidence double",
    "decision_edges": "src string, dst string, kind string, scope string, aspect string, rationale string",
    "conflicts": "conflict_id string, cluster_id string, topic string, summary string",
    "conflict_sides": "conflict_id string, side string, claimant string, claim string",
    "passages": "id bigint, message_id string, text string, embedding array<float>",
    "qa_log": "id bigint, question string, answer_json string, latency_ms bigint, created_at timestamp",
    "runs": "run_id string, stage string, started_at timestamp, finished_at timestamp, n_in bigint, n_out bigint, tokens_in bigint, tokens_out bigint, cost_usd double, notes string",
    "feedback": "id bigint, decision_id string, kind string, note string",
    "llm_cache": "key string, response string",
    "llm_calls": "run_id string, stage string, model string, cached boolean, tokens_in bigint, tokens_out bigint, cost_usd double",
    "embed_cache": "key string, vec array<float>",
    "events": "run_id string, seq bigint, kind string, stage string, payload string",
}
# Schemas of model answers, as closed structs.
EVIDENCE = "struct<message_id:string,quote:string,role:string>"
ANSWERS = {
    "triage": "has_candidate boolean, messages array<struct<message_id:string,signal:string,note:string>>",
    "extract": f"records array<struct<topic_label:string,decision_text:string,stance:string,decision_type:string,decided_by:array<string>,decision_date:string,rationale:string,alternatives:array<string>,conditions:string,overrides_hint:string,authority_note:string,confidence:double,evidence:array<{EVIDENCE}>>>",
    "cluster": "groups array<struct<label:string,record_ids:array<string>>>",
    "reconcile": f"cluster_topic string, decisions array<struct<decision_id_temp:string,canonical_text:string,decided_by:array<string>,decided_at:string,rationale:string,alternatives:array<string>,decision_type:string,status:string,authority_flag:boolean,authority_note:string,merged_record_ids:array<string>,confidence:double,evidence:array<{EVIDENCE}>>>, edges array<struct<src:string,dst:string,kind:string,scope:string,aspect:string,rationale:string>>, conflicts array<struct<topic:string,summary:string,sides:array<struct<claimant:string,claim:string,evidence:array<{EVIDENCE}>>>>>, current_state string, non_decisions array<struct<record_ids:array<string>,reason:string>>",
    "answer": "status string, answer_md string, citations array<struct<n:int,message_id:string,quote:string>>, decision_ids array<string>, confidence string, caveats array<string>, closest array<struct<message_id:string,why:string>>",
    "classify": "type string, entities array<string>, as_of_date string",
    "identity": "same_person boolean",
    "role": "role string, org string",
    "same_decision": "verdict string",
    "supports": "supports boolean",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
