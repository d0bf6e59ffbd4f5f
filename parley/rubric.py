"""The agent-quality rubric, and the bands and limits derived from it.

A rubric is a value: pass another one to rescore history under a revision.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of rubric 1.0.0.
VERSION = "1.0.0"
WEIGHTS = {
    "module1_reception": 0.15,
    "module2_offer": 0.25,
    "module3_objections": 0.25,
    "module4_followup": 0.20,
    "module5_closing": 0.15,
}
CAPS = {
    "module1_reception": {
        "greeting": 25,
        "understanding_confirmation": 25,
        "missing_info_request": 25,
        "next_step_transition": 25,
    },
    "module2_offer": {
        "attitude": 25,
        "offer_completeness": 25,
        "value_selling": 25,
        "alternative_offer": 25,
    },
    "module3_objections": {
        "price_objection": 25,
        "competitor_objection": 25,
        "thinking_time_objection": 25,
        "unavailable_service_objection": 25,
    },
    "module4_followup": {"timing": 40, "frequency": 30, "message_quality": 30},
    "module5_closing": {
        "payment_request": 30,
        "next_steps_confirmation": 20,
        "thank_you": 20,
        "booking_steps": 20,
        "service_review_request": 10,
    },
}
NULLABLE = frozenset({
    "module2_offer.offer_completeness",
    "module2_offer.alternative_offer",
    "module3_objections.price_objection",
    "module3_objections.competitor_objection",
    "module3_objections.thinking_time_objection",
    "module3_objections.unavailable_service_objection",
    "module4_followup.timing",
    "module4_followup.frequency",
    "module4_followup.message_quality",
    "module5_closing.payment_request",
    "module5_closing.next_steps_confirmation",
    "module5_closing.thank_you",
    "module5_closing.booking_steps",
    "module5_closing.service_review_request",
})
OFFER_STAGES = ("offer_presented", "negotiation", "closing_attempted", "deal_closed")
MIN_WEIGHT_APPLIED = 0.40
BANDS = ((85, "Excellent"), (70, "Good"), (55, "Average"))
LOWEST_BAND = "Below Average"


@dataclass(frozen=True)
class Rubric:
    weights: dict = field(default_factory=lambda: WEIGHTS)
    caps: dict = field(default_factory=lambda: CAPS)
    nullable: frozenset = NULLABLE
    min_weight: float = MIN_WEIGHT_APPLIED
    version: str = VERSION

    def criteria(self):
        """(module, criterion, cap, may be null), in rubric order."""
        for module, caps in self.caps.items():
            for name, cap in caps.items():
                yield module, name, cap, f"{module}.{name}" in self.nullable


DEFAULT = Rubric()
