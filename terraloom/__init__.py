"""Terraloom: a PySpark-native engine for survey-imagery analytics."""
