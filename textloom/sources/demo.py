"""A few made-up documents, for when there are no files yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .readers import from_rows

TOPICS = {
    "espalda": ("dolor de espalda", "la zona lumbar", "levantar peso", "calor local y reposo"), "gripe": ("gripe", "la fiebre", "el contacto con enfermos", "líquidos y descanso"),
    "asma": ("asma", "los bronquios", "el polvo y el frío", "un inhalador"), "migraña": ("migraña", "la cabeza", "la falta de sueño", "un cuarto oscuro"),
    "diabetes": ("diabetes", "el azúcar en la sangre", "el sobrepeso", "una dieta equilibrada"), "alergia": ("alergia", "la nariz y los ojos", "el polen", "antihistamínicos"),
    "anemia": ("anemia", "los glóbulos rojos", "la falta de hierro", "legumbres y carne"), "tos": ("tos seca", "la garganta", "el humo", "miel y agua tibia"),
    "piel": ("piel irritada", "los brazos", "jabones fuertes", "una crema suave"), "sueño": ("insomnio", "el descanso nocturno", "las pantallas", "un horario fijo"),
}


def demo_documents(spark: SparkSession) -> DataFrame:
    """Two documents a topic."""
    rows = []
    for name, (what, where, why, how) in TOPICS.items():
        rows.append({"doc_id": f"doc_{name}_001", "url": f"https://example.org/{name}/1", "metadata": {"title": f"Qué es: {what}"}, "text": f"El problema llamado {what} afecta a {where}. Muchas veces empieza por {why}. Los médicos lo reconocen por sus síntomas y preguntan cuánto dura."})
        rows.append({"doc_id": f"doc_{name}_002", "url": f"https://example.org/{name}/2", "metadata": {"title": f"Cómo tratar: {what}"}, "text": f"Contra {what} ayuda sobre todo {how}. Conviene evitar {why} y cuidar {where}. Si el tratamiento no mejora nada en una semana, hay que volver a la consulta."})
    return from_rows(spark, rows)
