"""Queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, class_lm, decontaminate, filter_audit, hard_negatives, license_scan, merkle, near_dedup, packing, quality_classifier, quality_rules, simhash, url_filter


def queries() -> dict:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_class_lm": class_lm.op4_class_lm,
        "op5_packing": packing.op5_packing,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_merkle": merkle.op9_merkle,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_simhash": simhash.op11_simhash,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_filter_audit": filter_audit.op13_filter_audit,
        # what SQL can express of operators that it cannot express whole
        "quality_base": quality_rules.quality_base,
        "lm_base_scores": class_lm.lm_base_scores,
        # the same operators where the tables give them too little to do
        "quoted_conversations": chat_format.quoted_conversations,
        "url_filter_interlinked": url_filter.url_filter_interlinked,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": near_dedup.OP1_SQL,
        "op2_chat_format": chat_format.OP2_SQL,
        "op6_license_scan": license_scan.OP6_SQL,
        "op7_url_filter": url_filter.OP7_SQL,
        "op9_merkle": merkle.OP9_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
        "quality_base": quality_rules.BASE_SQL,
        "lm_base_scores": class_lm.BASE_SQL,
        "quoted_conversations": chat_format.QUOTED_SQL,
        "url_filter_interlinked": url_filter.INTERLINKED_SQL,
    }
