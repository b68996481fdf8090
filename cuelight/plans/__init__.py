"""Whole workflows over project folders."""
