"""taskloom.operators"""
