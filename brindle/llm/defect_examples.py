"""Pairs labelled by hand, on which the cutoffs of the defect posteriors are validated: (question, answer, finish reason, defects)."""

_Q = "Summarise how the bridge sensor was calibrated in spring. Name the two tests that failed and say whether the budget of 40 hours was kept."
_FR = "Explique comment le capteur du pont a été étalonné au printemps. Quels essais ont échoué, et est-ce que le budget est respecté ?"
_DE = "Erkläre bitte, wie der Sensor der Brücke geeicht wurde und welche Prüfungen nicht bestanden worden sind."
_ES = "Explica cómo se calibró el sensor del puente y cuáles son las pruebas que no fueron superadas según el informe."
_RU = "Объясните, как был откалиброван датчик моста и какие проверки не были пройдены."
_GOOD = "The sensor was calibrated against a steel reference in April. The drift test and the heat test failed. The work took 37 hours, so the budget was kept."

LABELLED: list[tuple[str, str | None, str | None, set[str]]] = [
    (_Q, _GOOD, "stop", set()),
    (_Q, "Two tests failed:\n\n- drift\n- heat\n\nThe budget was kept.", "stop", set()),
    (_Q, "```python\nprint(37)\n```", "stop", set()),
    (_Q, '{"failed": ["drift", "heat"], "hours": 37}', "stop", set()),
    (_Q, "Unfortunately the heat test failed twice; the drift test failed once. Hours spent: 37.", "stop", set()),
    (_Q, "I can't say more about the drift test than the log does: it failed at 0.7 mm on 12 April. The heat test failed too.", "stop", set()),
    (_Q, "You ask whether the budget of 40 hours was kept: it was, with 37 hours. The drift test and the heat test failed.", "stop", set()),
    (_FR, "Le capteur a été étalonné en avril avec une référence en acier. Les essais de dérive et de chaleur ont échoué, mais le budget est respecté.", "stop", set()),
    (_DE, "Der Sensor wurde im April mit einer Referenz aus Stahl geeicht. Die Prüfung der Drift und die der Wärme sind nicht bestanden worden.", "stop", set()),
    (_ES, "El sensor se calibró en abril con una referencia de acero. La prueba de deriva y la de calor no fueron superadas.", "stop", set()),
    (_RU, "Датчик был откалиброван в апреле по стальному эталону. Проверки на дрейф и на нагрев не были пройдены.", "stop", set()),
    (_Q + " Answer in French, please.", "Le capteur a été étalonné en avril avec une référence en acier. Les essais de dérive et de chaleur ont échoué.", "stop", set()),
    (_Q, "", "stop", {"empty"}),
    (_Q, None, "stop", {"empty"}),
    (_FR, "  \n​", "length", {"empty"}),
    (_DE, " ", None, {"empty"}),
    (_Q, "I'm sorry, but I can't assist with that.", "stop", {"refusal"}),
    (_Q, "Sorry, I am not able to answer this. Please consult a specialist.", "stop", {"refusal"}),
    (_Q, "This is something I won't do.", "stop", {"refusal"}),
    (_FR, "Je regrette, mais je ne peux pas vous aider sur ce sujet.", "stop", {"refusal"}),
    (_DE, "Leider kann ich dabei nicht helfen.", "stop", {"refusal"}),
    (_ES, "Lo siento, no puedo ayudar con esta solicitud.", "stop", {"refusal"}),
    (_RU, "К сожалению, я не могу помочь с этим запросом.", "stop", {"refusal"}),
    (_Q, _Q, "stop", {"echo"}),
    (_Q, "> " + _Q, "stop", {"echo"}),
    (_FR, _FR, "stop", {"echo"}),
    (_RU, "Вы спросили: " + _RU, "stop", {"echo"}),
    (_Q, "Der Sensor wurde im April mit einer Referenz aus Stahl geeicht. Die Prüfung der Drift und die der Wärme sind nicht bestanden worden.", "stop", {"language"}),
    (_Q, "Le capteur a été étalonné en avril avec une référence en acier. Les essais de dérive et de chaleur ont échoué, mais le budget est respecté.", "stop", {"language"}),
    (_FR, "El sensor se calibró en abril con una referencia de acero. La prueba de deriva y la de calor no fueron superadas según el informe.", "stop", {"language"}),
    (_ES, "Le capteur a été étalonné en avril avec une référence en acier. Les essais de dérive et de chaleur ont échoué, mais le budget est respecté.", "stop", {"language"}),
    (_DE, _GOOD, "stop", {"language"}),
    (_Q, "Датчик был откалиброван в апреле по стальному эталону. Проверки не были пройдены.", "stop", {"language"}),
    (_RU, _GOOD, "stop", {"language"}),
    (_Q, "The sensor was calibrated against a steel reference in April, and the", "length", {"truncated"}),
    (_Q, "The sensor was calibrated against a steel reference in April. The drift test fai", "stop", {"truncated"}),
    (_Q, "Two tests failed:\n\n1. the drift test.\n2. the heat test.\n3.", "stop", {"truncated"}),
    (_Q, "The script is this:\n\n```python\nfor t in tests:\n    run(t", "length", {"truncated"}),
    (_Q, '{"failed": ["drift", "he', "length", {"truncated"}),
    (_DE, "Der Sensor wurde im April mit einer Referenz aus Stahl geeicht, weil die", "length", {"truncated"}),
    (_Q, "Der Sensor wurde im April mit einer Referenz aus Stahl geeicht und die Prüfung der Wärme ist nicht bestanden worden, weil die", "length", {"language", "truncated"}),
    (_FR, "The sensor was calibrated against a steel reference in April because the heat test and the", "length", {"language", "truncated"}),
]
